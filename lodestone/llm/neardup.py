"""Near-duplicate records by a Gray-order hierarchical index over fingerprints (problem 4).

A record is the set of its distinct sequences of ``shingle`` words.  Its fingerprint has 128
bits, each the lowest bit of one min-hash: the sets' similarity J makes each bit agree with
probability (1 + J) / 2, so similar records are near in Hamming distance.

The index has upper nodes that each hold one masked pattern all members share: here two whole
min-hash values, in each of NODES choices of which two.  A pair of similarity J meets in at least
one with probability 1 - (1 - J^2)^NODES: 0.998 at 0.6, more above.  Below an upper node the
members are sorted by Gray rank, which puts fingerprints side by side that differ in few bits;
runs of FAN neighbours form a node with the bits they all share (mask and pattern), and runs of
these the next level.  A search adds up the differences to a node's shared bits and drops the
whole group when they exceed the limit.  What is left is verified on the exact sets.

Records with equal sets are one class and enter once.  All nodes of a task are one forest, searched
level by level at once, whatever their sizes.  Upper nodes too large for one task are cut into
blocks, and each pair of blocks is a task of its own; those of very many blocks are refined: a
further min-hash value joins the pattern, in each of REFINED choices of which, so that a node costs
a constant number of rows per member and a pair still meets with probability 1 - (1 - J)^REFINED.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcodes as tc
from lodestone.session import cut, spread

NODES = 14
BITS = 128
FAN = 16
#: Members of an upper node that one task searches; larger ones are cut into blocks of this size.
NODE_ROWS = 8_192
#: Blocks of an upper node from which it is refined, choices of the value that joins, and how often.
MOST_BLOCKS, REFINED, DEPTH = 8, 8, 3
#: Edges of one end from which they are joined in parts, and the number of parts.
HUB, SALTS = 100_000, 32
#: Standard deviations of the Hamming distance allowed above its mean at the threshold.
SLACK = 2.7


def limit_of(threshold: float) -> int:
    """Largest Hamming distance at which two fingerprints are still compared exactly."""
    p = (1 - threshold) / 2
    return int(np.ceil(BITS * p + SLACK * np.sqrt(BITS * p * (1 - p))))


def shingles_of(words: np.ndarray, first: np.ndarray, size: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of at least ``min_words`` words, and the text of each."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = tc.mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    ok = (text[: len(h)] == text[size - 1 :]) & (n[text[: len(h)]] >= max(min_words, size))
    h, t = h[ok], text[: len(ok)][ok]
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], t[new]


_SEEDS = np.random.default_rng(20_11).integers(1, 2**63, BITS).astype(np.uint64)


def _fingerprints(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            codes, begins = tc.codes_of(batch.column(1))
            for a, z in tc.chunks(begins, 1 << 18):
                words, _, first = tc.words_of(codes[begins[a] : begins[z]], begins[a : z + 1] - begins[a])
                h, t = shingles_of(words, first, size, min_words)
                if not len(h):
                    continue
                head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                # a cheap family of hashes: odd multiples, mixed by their upper bits
                mins = np.empty((BITS, len(head)), np.uint64)
                for k, seed in enumerate(_SEEDS):
                    x = (h ^ seed) * (seed | np.uint64(1))
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    mins[k] = np.minimum.reduceat(x, head)
                bit = (tc.mix(mins) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bit, axis=0).T.copy().view(np.uint64)
                keys = np.stack([tc.mix(tc.mix(mins[2 * j] + np.uint64(j)) + mins[2 * j + 1]) for j in range(NODES)], 1)
                more = (mins[2 * NODES : 2 * NODES + REFINED * DEPTH] >> np.uint64(32)).astype(np.uint32).T
                whole = tc.mix(np.add.reduceat(tc.mix(h), head) ^ np.bitwise_xor.reduceat(tc.mix(h + np.uint64(9)), head))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a + t[head]]), pa.array(whole.view(np.int64)),
                        pa.array(packed[:, 0].copy().view(np.int64)), pa.array(packed[:, 1].copy().view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), NODES).cast(pa.list_(pa.int64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(more).ravel().view(np.int32)), REFINED * DEPTH).cast(pa.list_(pa.int32())),
                    ],
                    names=["id", "sh", "hi", "lo", "keys", "more"],
                )

    return run


def gray_rank(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of 128-bit words in the Gray code: each bit is the parity of the bits from it up."""
    for s in (1, 2, 4, 8, 16, 32):
        lo = lo ^ (lo >> np.uint64(s))
        hi = hi ^ (hi >> np.uint64(s))
    parity = hi & np.uint64(1)
    return hi, np.where(parity == 1, ~lo, lo)


class Forest:
    """Trees over rows sorted by (key, Gray rank), one for each key.

    A node stands for FAN neighbours of the level below it, within its key, and has the bits that
    all of them know and share.  Levels go up to one node per key.
    """

    def __init__(self, fp: np.ndarray, key: np.ndarray):
        self.fp = fp
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.size = np.diff(np.r_[head, len(key)])
        self.tree = np.repeat(np.arange(len(head)), self.size)  # of each row
        # per level: values, masks, first node and number of nodes of each tree
        self.levels = [(fp, np.full_like(fp, ~np.uint64(0)), head, self.size)]
        while self.levels[-1][3].max(initial=1) > 1:
            self.levels.append(self._above(*self.levels[-1]))

    @staticmethod
    def _above(value, mask, first, count):
        place = np.arange(len(value)) - np.repeat(first, count)
        head = np.flatnonzero(place % FAN == 0)
        begin = value[head]
        apart = value ^ np.repeat(begin, np.diff(np.r_[head, len(value)]), axis=0)
        shared = np.bitwise_and.reduceat(mask & ~apart, head, axis=0)
        count = -(-count // FAN)
        return begin & shared, shared, np.cumsum(count) - count, count

    def near(self, limit: int, work: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i < j) of rows of one key that differ in ``limit`` bits or fewer."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        load = np.cumsum(self.size[self.tree]) if len(self.fp) else np.zeros(0, np.int64)
        blocks = np.searchsorted(load, np.arange(work, load[-1] + work, work)) if len(load) else []
        begin = 0
        for end in [min(len(self.fp), int(x) + 1) for x in blocks]:
            if end <= begin:
                continue
            q = np.arange(begin, end)
            begin = end
            node = self.levels[-1][2][self.tree[q]]
            for depth in range(len(self.levels) - 1, -1, -1):
                value, mask, first, count = self.levels[depth]
                tree = self.tree[q]
                place = node - first[tree]
                # only partners behind the query
                behind = self.levels[0][2][tree] + np.minimum((place + 1) * FAN**depth, self.size[tree]) - 1 > q
                apart = np.bitwise_count((self.fp[q] ^ value[node]) & mask[node]).sum(1)
                kept = behind & (apart <= limit)
                q, node, tree, place = q[kept], node[kept], tree[kept], place[kept]
                if depth:
                    below, n = self.levels[depth - 1][2], self.levels[depth - 1][3]
                    children = np.minimum(FAN, n[tree] - place * FAN)
                    nth = np.arange(children.sum()) - np.repeat(np.cumsum(children) - children, children)
                    q, node = np.repeat(q, children), np.repeat(below[tree] + place * FAN, children) + nth
            kept = node > q
            left.append(q[kept])
            right.append(node[kept])
        return np.concatenate(left), np.concatenate(right)


def _search_nodes(limit: int, two_blocks: bool):
    """Rows sorted by node key -> candidate pairs.  Columns: key, id, hi, lo and the block (-1 or
    its side in a pair of different blocks, of which only pairs across are wanted)."""

    def settle(key, ids, hi, lo, side):
        g1, g2 = gray_rank(hi, lo)
        order = np.lexsort((g2, g1, key))
        key, ids, side = key[order], ids[order], side[order]
        i, j = Forest(np.stack([hi[order], lo[order]], 1), key).near(limit)
        if two_blocks:
            ok = (side[i] != side[j]) | (side[i] < 0)
            i, j = i[ok], j[ok]
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:  # sorted by key; a node may go over several batches
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            key = rest["key"].to_numpy()
            done = int(np.searchsorted(key, key[-1]))
            if done >= 100_000:
                out = whole(rest.slice(0, done))
                if out is not None:
                    yield out
                rest = rest.slice(done)
        if rest is not None and len(rest):
            out = whole(rest)
            if out is not None:
                yield out

    def whole(t: pa.Table):
        u = lambda c: t[c].to_numpy().view(np.uint64)
        return settle(t["key"].to_numpy(), t["id"].to_numpy(), u("hi"), u("lo"), t["side"].to_numpy())

    return run


def candidates(classes: DataFrame, limit: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct pairs (a < b) of class ids whose fingerprints are near and that share an upper node."""

    def searched(rows: DataFrame, two_blocks: bool) -> DataFrame:
        # by a hash of the key: rows that come from a join by the key count as dealt out by it, so that
        # repartition("key") is dropped, and the adaptive plan may then read them as the maps wrote them
        return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(_search_nodes(limit, two_blocks), "a bigint, b bigint")

    rows = classes.select("id", "hi", "lo", F.explode("keys").alias("key"))
    found = []
    for depth in range(DEPTH + 1):
        # few nodes are large, mostly none: their keys are counted before anything moves
        hot = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > node_rows))
        some = not hot.isEmpty()
        hot = F.broadcast(hot)  # one key per node_rows rows at most
        plain = rows.join(hot, "key", "left_anti") if some else rows
        found.append(searched(plain.select("key", "id", "hi", "lo", F.lit(-1).alias("side")), False))
        if not some:
            break
        large = rows.join(hot, "key")
        refined = (F.col("n") > MOST_BLOCKS * node_rows) if depth < DEPTH else F.lit(False)
        cut_up = (
            large.where(~refined)
            .withColumn("blocks", F.ceil(F.col("n") / node_rows).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
                "id", "hi", "lo",
                F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
            )
        )
        found.append(searched(cut_up, True))
        choices = F.array(*(F.xxhash64("key", F.lit(r), F.col("more")[depth * REFINED + r]) for r in range(REFINED)))
        rows = large.where(refined).join(classes.select("id", "more"), "id").select("id", "hi", "lo", F.explode(choices).alias("key"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _sets(size: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            codes, begins = tc.codes_of(batch.column(1))
            words, _, first = tc.words_of(codes, begins)
            h, t = shingles_of(words, first, size, min_words)
            ends = np.searchsorted(t, np.arange(len(ids) + 1)).astype(np.int32)
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, sets], names=["id", "s"])

    return run


class NearDuplicates:
    """Classes, members and similar pairs of one table of texts."""

    def __init__(self, df: DataFrame, threshold: float, shingle: int, min_words: int, id_col: str, text_col: str, node_rows: int = NODE_ROWS):
        source = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")
        )
        prints = cut(spread(source).mapInArrow(_fingerprints(shingle, min_words), "id bigint, sh bigint, hi bigint, lo bigint, keys array<bigint>, more array<int>"))
        classes = cut(prints.groupBy("sh").agg(
            F.min("id").alias("id"), F.max("id").alias("most"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.first("keys").alias("keys"), F.first("more").alias("more")
        ))
        several = classes.where("id < most").select("sh", F.col("id").alias("rep"))
        #: (rep, id): the members, the representative among them, of classes of two or more
        self.members = cut(prints.select("sh", "id").join(several, "sh").select("rep", "id").distinct())
        near = cut(candidates(classes, limit_of(threshold), node_rows))
        needed = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
        sets = cut(source.join(needed, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(shingle, min_words), "id bigint, s array<bigint>"))
        both = F.size(F.array_intersect("s", "s2"))
        #: (a, b): representatives of similar classes, a < b
        self.pairs = cut(
            near.join(sets.withColumnRenamed("id", "a"), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
            .where(both >= F.lit(threshold) * (F.size("s") + F.size("s2") - both) - 1e-9)
            .select("a", "b")
        )
        self.ids = prints.select("id", "sh")


def similar_pairs(df: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 12, id_col: str = "id", text_col: str = "content", node_rows: int = NODE_ROWS) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of at least ``min_words`` words whose sets of distinct
    ``shingle``-word sequences have a Jaccard similarity of ``threshold`` or more.

    Rows with the same id are one record; null ids and null or short texts have no pair; other
    columns are not read; an empty table gives no rows.  Every pair reported is exact; a similar
    pair is found with the probability the module names.  Members of a class of equal sets are
    joined to each other and to the partners of their class.
    """
    found = NearDuplicates(df, threshold, shingle, min_words, id_col, text_col, node_rows)
    m = found.members
    across = (
        found.pairs.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a", "left")
        .join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b", "left")
        .select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    )
    within = m.select("rep", F.col("id").alias("x")).join(m.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _to_least(both: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Edges (x, y) with the least neighbour of x.  Ends of more than ``hub`` edges, if there are any,
    are joined in SALTS parts, so that none is one task's work."""
    hubs = cut(least.where(F.col("n") > hub).select("x"))
    least = least.select("x", "m")
    if hubs.isEmpty():
        return both.join(least, "x")
    parts = least.join(hubs, "x", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = both.join(hubs, "x", "left_semi").withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int"))
    return both.join(hubs, "x", "left_anti").join(least, "x").unionByName(hot.join(parts, ["x", "salt"]).drop("salt"))


def components(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """(id, root): the smallest id of the connected component, for each id of pairs (a, b).

    Large-star and small-star in turn: each step hangs neighbours on the smallest one, so that
    the number of rounds grows with the logarithm of the diameter; each round is cut.
    """
    edges = pairs.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    before = None
    while True:
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("n"))
        large = _to_least(both, least, hub).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        edges = cut(
            small.select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        )
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "id")
    return roots.union(roots.select(F.col("root").alias("id"), "root")).distinct()


def groups(df: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 12, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, class_id, group_id, n_links): one row per record of at least ``min_words`` words.

    class_id is the smallest id with an equal set, group_id the smallest id that chains of similar
    pairs reach, n_links the number of other classes similar to the record's own.  Nulls, repeated
    rows and empty tables as in ``similar_pairs``.
    """
    found = NearDuplicates(df, threshold, shingle, min_words, id_col, text_col)
    links = found.pairs.select("a").union(found.pairs.select("b")).groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n_links"))
    roots = components(found.pairs).select(F.col("id").alias("class_id"), "root")
    least = found.ids.groupBy("sh").agg(F.min("id").alias("class_id"))
    return (
        found.ids.join(least, "sh").select("id", "class_id").distinct()
        .join(links, "class_id", "left").join(roots, "class_id", "left")
        .select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
