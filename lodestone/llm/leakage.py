"""Passages of held-out items inside documents (problem 7).

Texts are word sequences.  A passage is a window of ``window`` words; every window of a document
is tested against every window of the items.  Each window is embedded by the random walk of
Chakraborty, Goldenberg and Koucky: at each step the word under the cursor is put out, and a
random bit of that word and step decides whether the cursor moves on.  Windows within a few word
edits of each other get embeddings within a small Hamming distance, so sampling a few output
positions is a locality-sensitive hash for edit distance.  The number of repetitions follows
from the recall asked for, by simulation; equal windows have equal embeddings, so for ``edits=0`` one repetition
finds them all.  Every hit is verified on the words themselves.

The items are the small side: they are collected in blocks of at most MAX_WINDOWS windows, each
broadcast and run against all documents, which are neither shuffled nor collected; of several
blocks one is held at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcodes as tc
from lodestone.session import cut, spread

#: Windows of items in one broadcast: about 100 MB with their words at ten words each.
MAX_WINDOWS = 1_000_000
SAMPLES = 6
#: More repetitions than these are refused.
MAX_REPETITIONS = 2_000
PAD = np.uint64(0x7B1C5D3A9E2F4860)


def edited_windows(window: int, edits: int, most: int = 100) -> list[np.ndarray]:
    """Ways in which a window comes out of another one by ``edits`` edits: for each place the word
    of the other that stands there, -1 for a new one.  All of them, or ``most`` at random with
    those at the beginning, which part the walks for longest."""
    rng = np.random.default_rng(5)
    ways = {}
    for pairs in range(edits // 2 + 1):  # a word put in and one left out keep the length
        new = edits - 2 * pairs
        for n in range(20 * most if edits > 1 else window):
            at = [n] if edits == 1 else list(range(min(edits, window))) if n == 0 else rng.permutation(window).tolist()
            way = list(range(window))
            for p in at[:new]:
                way[p] = -1
            for p, q in zip(at[new::2], at[new + 1 :: 2][:pairs]):
                way.insert(p, -1)
                del way[q + (q >= p)]
            ways[tuple(way)] = None
            if len(ways) >= most * (pairs + 1):
                break
    return [np.array(w) for w in ways]


@functools.cache
def repetitions(window: int, edits: int, recall: float, trials: int = 20_000) -> int:
    """Repetitions of the hash that find a pair at ``edits`` edits with the given probability.

    The walks of the very seeds are simulated on windows of random words: the share of equal keys
    under each seed gives the probability that all seeds miss, which must be 1 - recall at most,
    three standard errors included, for each of the ways of edited_windows().
    """
    if edits == 0:
        return 1
    rng = np.random.default_rng(3)
    ways = edited_windows(window, edits)
    each = max(200, trials // len(ways))
    a = rng.integers(0, 2**63, (len(ways) * each, window)).astype(np.uint64)
    b = rng.integers(0, 2**63, a.shape).astype(np.uint64)
    way = np.repeat(np.stack(ways), each, axis=0)
    b = np.where(way < 0, b, np.take_along_axis(a, np.maximum(way, 0), 1))
    start = np.arange(len(a)) * window
    missed, variance = np.zeros(len(ways)), np.zeros(len(ways))
    for n in range(1, MAX_REPETITIONS + 1):
        same = walk_keys(a.ravel(), start, window, n) == walk_keys(b.ravel(), start, window, n)
        p = np.minimum(same.reshape(len(ways), each).mean(1), 1 - 1 / each)
        missed, variance = missed + np.log1p(-p), variance + p / (1 - p) / each
        if (missed + 3 * np.sqrt(variance) <= math.log(1 - recall)).all():
            return n
    raise ValueError(f"{edits} edits in {window} words need more than {MAX_REPETITIONS} repetitions for a recall of {recall}")


def walk_keys(words: np.ndarray, start: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Bit-sampled walk embedding of words[start : start + window] for each start."""
    rng = np.random.default_rng(seed)
    steps = 3 * window
    sampled = set(rng.choice(np.arange(0, 2 * window), min(SAMPLES, 2 * window), replace=False).tolist())
    # the bit of step j: bit j of a remixed word, so that one gather per step gives word and bit
    remixed = tc.mix(words ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    cursor = start.copy()
    end = start + window
    key = np.zeros(len(start), np.uint64)
    last = len(words) - 1
    for j in range(steps):
        inside = cursor < end
        w = remixed[np.minimum(cursor, last)]
        if j in sampled:
            key = tc.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, w, PAD))
            sampled.discard(j)
            if not sampled:
                break
        cursor += ((w >> np.uint64(j % 61)) & np.uint64(1)).astype(np.int64) & inside
    return key


def within_edits(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """For each row, whether the word edit distance of a and b is at most ``edits`` (banded)."""
    if edits == 0:
        return (a == b).all(1)
    n, w = a.shape
    big = np.int32(edits + 1)
    row = np.full((n, w + 1), big, np.int32)
    row[:, : edits + 1] = np.arange(edits + 1)[: w + 1]
    for i in range(1, w + 1):
        new = np.full((n, w + 1), big, np.int32)
        if i <= edits:
            new[:, 0] = i
        for j in range(max(1, i - edits), min(w, i + edits) + 1):
            best = row[:, j - 1] + (a[:, i - 1] != b[:, j - 1])
            np.minimum(best, row[:, j] + 1, out=best)
            np.minimum(best, new[:, j - 1] + 1, out=best)
            new[:, j] = np.minimum(best, big)
        row = new
    return row[:, w] <= edits


def _window_starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of each window, and the number of its text."""
    n = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    after = np.cumsum(n)
    return first[:-1][text] + (np.arange(len(text)) - (after - n)[text]), text


def distinct_windows(words: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that differ in their words, and for each window the place of its equal."""
    h = np.zeros(len(start), np.uint64)
    for k in range(window):
        h = tc.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[start + k])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    for a in range(1, len(order), 1 << 16):  # what meets by the hash is compared
        at = order[a - 1 : a + (1 << 16)]
        w = words[start[at][:, None] + np.arange(window)]
        new[a : a + (1 << 16)] |= (w[1:] != w[:-1]).any(1)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return start[order[new]], of


class _Items:
    """Windows of one block of items, by key.

    Equal windows enter once.  Items that hold a window are kept as sets, and most windows of a
    passage have the set of their neighbours, so that a passage many items share costs a document
    one row for each item and not one for each window of each.
    """

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, edits: int, recall: float):
        codes, begins = tc.codes_of(texts)
        self.words, _, first = tc.words_of(codes, begins)
        start, text = _window_starts(first, window)
        self.window, self.edits = window, edits
        start, of = distinct_windows(self.words, start, window)
        # distinct (window, item), in order
        order = np.lexsort((ids[text], of))
        of, item = of[order], ids[text[order]]
        new = np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])] if len(of) else np.zeros(0, bool)
        of, item = of[new], item[new]
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        size = np.diff(np.r_[head, len(of)])
        # sets of items by two sums of hashes of their members
        mixed = tc.mix(item.view(np.uint64) + np.uint64(1))
        sums = np.stack([np.add.reduceat(mixed, head), np.add.reduceat(tc.mix(mixed), head)], 1) if len(head) else np.zeros((0, 2), np.uint64)
        _, one, self.set_of = np.unique(sums, axis=0, return_index=True, return_inverse=True)
        self.set_of = self.set_of.ravel()
        self.set_size = size[one]
        self.set_begin = np.cumsum(self.set_size) - self.set_size
        self.set_items = np.concatenate([item[head[k] : head[k] + size[k]] for k in one]) if len(one) else np.zeros(0, np.int64)
        self.tables = []
        for seed in range(1, 1 + repetitions(window, edits, recall)):
            key = walk_keys(self.words, start, window, seed)
            order = np.argsort(key, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[key & np.uint64((1 << 22) - 1)] = True
            self.tables.append((seed, key[order], start[order], order, np.packbits(bits)))

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item id) pairs, distinct."""
        start, text = _window_starts(first, self.window)
        found = []
        for seed, keys, item_start, number, packed in self.tables:
            if not len(keys) or not len(start):
                continue
            k = walk_keys(words, start, self.window, seed)
            low = (k & np.uint64((1 << 22) - 1)).astype(np.int64)
            maybe = np.flatnonzero((packed[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
            a, z = np.searchsorted(keys, k[maybe], "left"), np.searchsorted(keys, k[maybe], "right")
            hit = z > a
            maybe, a, z = maybe[hit], a[hit], z[hit]
            for block in range(0, len(maybe), 4096):
                m, lo, n = maybe[block : block + 4096], a[block : block + 4096], (z - a)[block : block + 4096]
                row = np.repeat(np.arange(len(m)), n)
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                span = np.arange(self.window)
                ok = within_edits(words[start[m][row][:, None] + span], self.words[item_start[at][:, None] + span], self.edits)
                found.append(np.unique(np.stack([text[m][row[ok]], self.set_of[number[at[ok]]]], 1), axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, sets = np.unique(np.concatenate(found), axis=0).T
        n = self.set_size[sets]
        item = self.set_items[np.repeat(self.set_begin[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs = np.unique(np.stack([np.repeat(text, n), item], 1), axis=0)
        return pairs[:, 0], pairs[:, 1]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    edits: int = 0,
    recall: float = 0.99,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds ``window`` consecutive words of the item.

    With ``edits`` above 0 the window may differ by so many word edits; each such pair is found
    with probability ``recall`` at least, as simulated (see repetitions()).  Null, empty and short texts hold no window; null ids
    are left out; repeated rows count once; other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    kept = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")
    )
    total = kept.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 2 / MAX_WINDOWS))  # a word takes two characters at least
    source = spread(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")))
    out = None
    for b in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast(
            _Items(rows["i"].to_numpy(), rows["t"].combine_chunks(), window, edits, recall)
        )

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                codes, begins = tc.codes_of(batch.column(1))
                for a, z in tc.chunks(begins):
                    words, _, first = tc.words_of(codes[begins[a] : begins[z]], begins[a : z + 1] - begins[a])
                    if len(words):
                        t, i = found.hits(words, first)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + t]), pa.array(i)], names=["d", "i"])

        part = source.mapInArrow(run, "d bigint, i bigint").distinct()
        if blocks > 1:  # one block after the other, so that one broadcast is held at a time
            part = cut(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.distinct().toDF(doc_id, item_id)
