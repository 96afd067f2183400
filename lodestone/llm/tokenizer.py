"""Byte-level BPE encoding by backtracking (problem 6).

A text is cut into pieces as the vocabulary's pattern says, in numpy over whole batches.  Merging
is exact within a piece and never crosses pieces, and pieces repeat, so each task encodes a piece
once and keeps its ids.

A piece is encoded in time linear in its length: an Aho-Corasick automaton over all tokens
gives, at each byte, the tokens that begin there, longest first.  Tokens are taken greedily; a
token is accepted only if it can follow the one before it, which a pair-compatibility table
answers: two tokens are compatible if merging their joint bytes by rank gives exactly these two.
Where no token fits, the last one is given back and the next shorter one is tried; a bit per
byte marks the ends that have failed, so that no end is tried twice.  Since each prefix of an
exact encoding is itself exact and the exact encoding of a prefix is unique, what is left when
the end is reached is the encoding that merging by rank would give.

Decoding concatenates slices of one byte string, through a table of offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcodes as tc
from lodestone.session import spread

#: Pieces kept per task, and their code points at most; the table is emptied when full, which changes no result.
KEPT_PIECES, KEPT_LENGTH = 400_000, 64
#: Bytes of a piece whose tokens are looked for at once.
BLOCK = 1 << 16


class BacktrackingBpe:
    """Vocabulary tables of one ``.tiktoken`` file (a base64 token and its rank per line)."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
        self.tokens = [token for _, token in ranked]
        if [rank for rank, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must be 0, 1, 2 and so on")
        self.lengths = [len(t) for t in self.tokens]
        self.longest = max(self.lengths, default=1)
        self.joined = b"".join(self.tokens)
        self.offsets = np.zeros(len(self.tokens) + 1, np.int64)
        np.cumsum(self.lengths, out=self.offsets[1:])
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        # the last merge that makes each token, and the token of each pair that merges
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                self.parts.append((i, i))
                continue
            pair = self._last_merge(token, i)
            self.parts.append(pair)
            if pair[0] != i:
                self.merged[pair] = i
        self.compatible: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens left when the token's bytes are merged by all lower ranks."""
        piece = [self.rank[token[k : k + 1]] for k in range(len(token))]
        while len(piece) > 2:
            found = [(self.rank.get(self.tokens[a] + self.tokens[b], rank), k) for k, (a, b) in enumerate(zip(piece, piece[1:]))]
            best, k = min(found)
            if best >= rank:
                return rank, rank  # can't be made by merging; it stands only for itself
            piece[k : k + 2] = [best]
        return piece[0], piece[1]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves exactly (left, right)."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 1_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo the latest merge next to the border again and again.  A pair across the border
        # that would have merged before the neighbours were made contradicts the two tokens.
        bound = len(self.tokens)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < bound:
                return False
            later_left = left > right
            for take_left in (later_left, not later_left):
                if take_left:
                    inner = self.parts[left][1]
                    if inner != left:
                        bound, left = min(bound, left), inner
                        break
                else:
                    inner = self.parts[right][0]
                    if inner != right:
                        bound, right = min(bound, right + 1), inner
                        break
            else:
                return True

    def _starting(self, piece: bytes, block: int) -> list[list[int]]:
        """Tokens that begin at each byte of a block, the longest last."""
        begin = block * BLOCK
        size = min(BLOCK, len(piece) - begin)
        out: list[list[int]] = [[] for _ in range(size)]
        for end, token in self.automaton.iter(piece[begin : begin + size + self.longest].decode("latin-1")):
            start = end + 1 - self.lengths[token]
            if start < size:
                out[start].append(token)
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        lengths = self.lengths
        starting = self._starting(piece, 0)
        held, blocks = 0, {0: starting}
        failed = bytearray(n + 1)
        path: list[int] = []
        tried: list[int] = []  # per token of the path, how many of its start's tokens are left
        at, left = 0, -1
        while at < n:
            if at // BLOCK != held:  # only long pieces have several blocks, of which three are kept
                held = at // BLOCK
                if held not in blocks:
                    blocks = {b: x for b, x in blocks.items() if abs(b - held) == 1}
                    blocks[held] = self._starting(piece, held)
                starting = blocks[held]
            options = starting[at % BLOCK]
            if left < 0:
                left = len(options)
            before = path[-1] if path else -1
            while left:
                left -= 1
                token = options[left]
                if not failed[at + lengths[token]] and (before < 0 or self.fits(before, token)):
                    path.append(token)
                    tried.append(left)
                    at += lengths[token]
                    left = -1  # all that begin there
                    break
            else:
                failed[at] = 1
                token = path.pop()
                left = tried.pop()
                at -= lengths[token]
        return path

    def decode(self, ids: list[int]) -> bytes:
        o, b = self.offsets, self.joined
        return b"".join(b[o[i] : o[i + 1]] for i in ids)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: The white space of the vocabulary's pattern.
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = tc.kinds(np.arange(tc.TABLE, dtype=np.uint32))
    out = np.where(kind == tc.LETTER, _LETTER, np.where(kind == tc.DIGIT, _NUMBER, _OTHER)).astype(np.uint8)
    out[list(_WHITE)] = _SPACE
    return out


def piece_starts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, of all texts of a batch at once.

    A piece is a run of letters, of numbers or of other visible characters, with one space
    before it if there is one; or ``'s 't 'd 'm 'll 've 're`` where an apostrophe begins a
    piece; or a run of white space, without its last character where something visible follows.
    """
    n = len(codes)
    table = _classes()
    k = table[np.minimum(codes, tc.TABLE - 1)]
    rare = np.flatnonzero(codes >= tc.TABLE)
    if len(rare):
        kind = tc.kinds(codes[rare])
        k[rare] = np.where(kind == tc.LETTER, _LETTER, np.where(kind == tc.DIGIT, _NUMBER, _OTHER))
    edge = np.zeros(n + 3, bool)
    edge[begins] = True
    edge[n:] = True
    start = np.ones(n, bool)
    start[1:] = (k[1:] != k[:-1]) | edge[1:n]
    white = k == _SPACE
    # the last white character before something visible stands alone or joins it
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[codes[at] == 32] + 1] = False
    # contractions
    padded, kinds = np.append(codes, [0, 0, 0]), np.append(k, [9, 9, 9])
    quote = np.flatnonzero((codes == 39) & start & (kinds[1 : n + 1] == _LETTER) & ~edge[1 : n + 1])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in "sdmt"])
    pair = (two == ord("e")) & ((one == ord("v")) | (one == ord("r"))) | (two == ord("l")) & (one == ord("l"))
    long = ~short & pair & (kinds[quote + 2] == _LETTER) & ~edge[quote + 2]
    for found, length in ((quote[short], 2), (quote[long], 3)):
        start[found + 1] = False
        rest = found + length
        start[rest[rest < n]] = True
    return np.flatnonzero(start)


class PieceTable:
    """Ids of the pieces seen so far, by their own code points."""

    def __init__(self, bpe: BacktrackingBpe):
        self.bpe = bpe
        self.kept: dict[bytes, np.ndarray] = {}

    def ids(self, first: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        if len(self.kept) + len(first) > KEPT_PIECES:
            self.kept.clear()
        raw, out = codes.tobytes(), []
        for a, z in zip((4 * first).tolist(), (4 * ends).tolist()):
            piece = raw[a:z]
            got = self.kept.get(piece)
            if got is None:
                got = np.array(self.bpe.encode_piece(piece.decode("utf-32-le").encode("utf-8")), np.int32)
                if z - a <= 4 * KEPT_LENGTH:
                    self.kept[piece] = got
            out.append(got)
        return out


def distinct_pieces(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pieces that differ, and for each piece the place of its equal among them.

    Pieces, which cover all of ``codes``, meet by their hash and are compared by their characters
    with the first of the hash; one that differs from it stands for itself.
    """
    _, first, back = np.unique(tc.span_hash(tc.prefix_hash(codes), start, end), return_index=True, return_inverse=True)
    rep, length = first[back], end - start
    at = np.arange(len(codes)) + np.repeat(start[rep] - start, length)
    other = codes[np.minimum(at, len(codes) - 1)] != codes
    other = np.flatnonzero(np.logical_or.reduceat(other, start) | (length != length[rep]))
    back[other] = len(first) + np.arange(len(other))
    return np.concatenate([first, other]), back


def encode_batch(texts: pa.Array, table: PieceTable) -> pa.Array:
    """Ids of each text as a list array; a null or empty text gives an empty list."""
    codes, begins = tc.codes_of(texts)
    values, counts = [], [np.zeros(1, np.int64)]
    for a, z in tc.chunks(begins):
        c, b = codes[begins[a] : begins[z]], begins[a : z + 1] - begins[a]
        if not len(c):
            counts.append(np.zeros(z - a, np.int64))
            continue
        start = piece_starts(c, b)
        end = np.append(start[1:], len(c))
        first, back = distinct_pieces(c, start, end)
        ids = table.ids(start[first], end[first], c)
        flat = np.concatenate(ids)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = np.cumsum(size) - size
        n = size[back]
        after = np.cumsum(n)
        values.append(flat[np.repeat(begin[back] - (after - n), n) + np.arange(after[-1])])
        of = np.append(0, after)[np.searchsorted(start, b)]
        counts.append(np.diff(of))
    ends = np.cumsum(np.concatenate(counts))
    flat = np.concatenate(values) if values else np.zeros(0, np.int32)
    if ends[-1] > np.iinfo(np.int32).max:
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """One row (id, ids) per row of df: token ids of the text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded like any other; strings
    that look like special tokens are ordinary text.  Repeated rows and null ids stay as they
    are, other columns of df are not read, an empty table gives an empty result.  ``path`` is
    the vocabulary file, the same on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(_vocabulary(path))
        for batch in batches:
            ids = encode_batch(batch.column(1), table)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return (
        spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        .mapInArrow(run, f"id {kind}, ids array<int>")
        .toDF(id_col, ids_col)
    )


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The inverse of ``encode``; null and empty lists give an empty text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(path)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return (
        df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
        .mapInArrow(run, f"id {kind}, text string")
        .toDF(id_col, text_col)
    )
