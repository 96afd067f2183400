"""The most similar vectors of every vector, by a permutation index (problem 1).

Pivots are a random sample of the vectors, one for about CELL vectors, so dense regions hold as
many more pivots as they hold more vectors.  Each vector is represented by its PREFIX nearest
pivots in order (looked for in the PROBED nearest of about sqrt(pivots) groups of pivots), and
posted in the inverted files of its first POSTED pivots.  Within every file the members are ranked
by the footrule distance of their orders, the best RERANK are reranked by the cosine, and the best
k of all files a vector is posted in are its result.

A file of more than FILE_ROWS members is an index of its own: pivots are drawn among its members,
and all of the above is done again inside it, so that no file costs the square of its size.  A file
that is expected to be too large for one task is posted in several parts, one for each of the next
NEXT pivots of the member's order.

A posting carries the vector as the difference from the file's pivot in one byte per number: the
difference is short, so a similarity is wrong by about 0.00002.  With float32 postings (exact=True)
it is not wrong at all, for four times the shuffle.

Rows of one hash are a class, of which the k + 1 smallest ids are posted.  A hash parts vectors of
one direction whose float32 numbers are rounded apart, so equality at nine decimals is settled on
the side, whatever is posted: classes that share a cell of random projections (neighbouring cells
included, where a projection lies near a border) are compared in float64, and each id gets the k
smallest ids among the classes equal to its own by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textcodes as tc
from lodestone.session import cut

CELL = 48
PREFIX = 12
POSTED = 4
RERANK = 160
#: Groups of pivots in which a vector's nearest pivots are looked for.
PROBED = 16
#: Bounds of the number of pivots; MAX_PIVOTS of 768 numbers take 50 MB in a broadcast.
MIN_PIVOTS, MAX_PIVOTS = 32, 16_384
#: Members from which an inverted file is searched by pivots of its own.
FILE_ROWS = 400
#: Members, as estimated from the pivots, from which a file is cut over tasks: about 120 MB each.
TASK_ROWS = 150_000
NEXT = 4
#: Ids that may be broadcast (8 MB) where equality is settled; more are joined.
MAX_IDS = 1_000_000
#: Random projections of a cell, and the width of a cell in margins (see cells()).
PROJECTIONS, WIDTH = 8, 32
#: Length of the difference of two vectors of length one whose cosine is 1 at nine decimals, at most.
EQUAL = 3.17e-5
#: What is not settled as equal stays below it.
BELOW_ONE = np.nextafter(np.float32(1), np.float32(0))


def unit_rows(embedding: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dims`` numbers, none NaN or infinite and not all zero: their numbers in
    the batch, and their vectors at length one."""
    n = len(embedding)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
    offsets = embedding.offsets.to_numpy()
    values = embedding.values.to_numpy(zero_copy_only=False).astype(np.float32)
    ok = np.flatnonzero((np.diff(offsets) == dims) & embedding.is_valid().to_numpy(zero_copy_only=False))
    x = values[offsets[ok][:, None] + np.arange(dims)] if len(ok) else np.zeros((0, dims), np.float32)
    size = np.abs(x).max(1, initial=0)
    good = np.isfinite(x).all(1) & (size > 0)
    ok, x, size = ok[good], x[good], size[good]
    x = x / size[:, None]
    return ok, x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)).astype(np.float32)[:, None]


def vector_hash(x: np.ndarray) -> np.ndarray:
    """64-bit hash of each row's direction (rounded; see cells() for equal ones that this parts)."""
    q = np.rint(x * np.float32(1 << 20)).astype(np.int64).view(np.uint64)
    weights = tc.mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    return tc.mix((tc.mix(q) * weights).sum(1, dtype=np.uint64))


def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell), a row one time or several: rows equal at nine decimals share a cell.

    A cell is a hash of the rounded random projections.  Projections of equal rows differ by less
    than the margin, which is EQUAL or, in many dimensions, seven standard deviations of what a
    difference of that length gives; a row whose projection is nearer than that to a border is in
    the cells on both sides of it.
    """
    dims = x.shape[1]
    directions = np.random.default_rng(11).normal(size=(dims, PROJECTIONS))
    directions = (directions / np.linalg.norm(directions, axis=0)).astype(np.float32)
    margin = EQUAL * min(1.0, 7 / math.sqrt(dims)) + 1e-6
    at = (x @ directions).astype(np.float64) / (WIDTH * margin)
    weights = tc.mix(np.arange(1, PROJECTIONS + 1, dtype=np.uint64)) | np.uint64(1)
    rows, total = np.arange(len(x)), np.zeros(len(x), np.uint64)
    for p in range(PROJECTIONS):
        low = np.floor(at[:, p] - 1 / WIDTH).astype(np.int64)[rows]
        high = np.floor(at[:, p] + 1 / WIDTH).astype(np.int64)[rows]
        both = np.flatnonzero(low != high)
        part = np.concatenate([low, high[both]]).view(np.uint64)
        rows, total = np.concatenate([rows, rows[both]]), np.concatenate([total, total[both]])
        total = total + tc.mix(part) * weights[p]
    return rows, tc.mix(total)


def _hashes(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = unit_rows(batch.column(1), dims)
            rows, cell = cells(x)
            by = np.argsort(rows, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(ok)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell[by].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(vector_hash(x).view(np.int64)), lists], names=["id", "h", "cells"])

    return run


def _celled(shared, dims: int):
    """(id, embedding) -> (cell, id, hash, vector) of the ids shared (or of all), one row per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                wanted = shared.value  # ascending
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)
                batch = batch.take(pa.array(np.flatnonzero(wanted[place] == ids)))
            ok, x = unit_rows(batch.column(1), dims)
            rows, cell = cells(x)
            h, of = vector_hash(x).view(np.int64), pa.array(ok[rows])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.view(np.int64)), batch.column(0).take(of), pa.array(h[rows]), batch.column(1).take(of)], names=["cell", "id", "h", "v"]
            )

    return run


def _unit64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class EqualRows:
    """For each row of a stream, in order of ids, the first ``most`` rows whose cosine with it is 1
    at nine decimals, itself included.

    Only rows that still lack some when they come are kept to compare with: a row that has ``most``
    of them adds none to any other, which has the same.  So many equal rows cost neither the
    square of their number nor their size in memory.
    """

    def __init__(self, most: int):
        self.most = most
        self.x: list[np.ndarray] = []
        self.ids, self.found = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(name, name of an equal row) pairs that the block adds."""
        x = _unit64(x)
        out = []
        heads = np.concatenate(self.x) if self.x else x[:0]
        if len(heads):
            self.x = [heads]
        same = np.round(heads @ x.T, 9) >= 1
        own = np.round(x @ x.T, 9) >= 1
        np.fill_diagonal(own, True)
        # kept rows that lack some, and rows of the block behind all kept ones
        more = same & (self.found[:, None] + np.cumsum(same, axis=1) <= self.most)
        i, j = np.nonzero(more)
        out.append((self.ids[i], names[j]))
        self.found = self.found + more.sum(1)
        both = np.concatenate([same.T, own], axis=1)
        both &= np.cumsum(both, axis=1) <= self.most
        i, j = np.nonzero(both)
        out.append((names[i], np.concatenate([self.ids, names])[j]))
        new = np.flatnonzero(both[:, : len(heads)].sum(1) < self.most)
        # of many equal rows in one block the first ones are enough
        if len(new):
            before = np.tril(own, -1)[np.ix_(new, new)].sum(1) + same[:, new].sum(0)
            new = new[before < self.most]
        self.x.append(x[new])
        self.ids, self.found = np.concatenate([self.ids, names[new]]), np.concatenate([self.found, both[new].sum(1)])
        q, c = (np.concatenate(v) for v in zip(*out))
        return q, c


def _equal(dims: int, k: int):
    """Rows of _celled(), sorted by cell and id -> (h, other): classes equal at nine decimals, the
    k + 1 with the smallest ids (no other class can hold one of the k + 1 smallest ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, before = None, None, None
        for batch in batches:
            cell, h = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(h), dims)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(cell)]):
                if cell[s] != last:
                    last, rows, before = cell[s], EqualRows(k + 1), None
                for a in range(s, e, 1_024):
                    z = min(e, a + 1_024)
                    first = a + np.sort(np.unique(h[a:z], return_index=True)[1])
                    first = first[h[first] != before] if before is not None else first  # an id delivered twice
                    before = h[z - 1]
                    if len(first):
                        q, c = rows.add(h[first], v[first])
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c)], names=["h", "other"])

    return run


def _usable(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(unit_rows(batch.column(1), dims)[0]))

    return run


class Pivots:
    """Pivots in groups, each under the nearest of about sqrt(pivots) of them."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.heads = rows[: math.ceil(math.sqrt(len(rows)))]
        under = np.concatenate([np.argmax(rows[a : a + 4_096] @ self.heads.T, axis=1) for a in range(0, len(rows), 4_096)])
        self.groups = [np.flatnonzero(under == g) for g in range(len(self.heads))]

    def orders(self, x: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivots of each row in order (fewer than ``prefix`` only where there are
        fewer), and their similarities."""
        probed, m = min(PROBED, len(self.heads)), min(prefix, len(self.rows))
        sim = x @ self.heads.T
        near = np.argpartition(-sim, probed - 1, axis=1)[:, :probed]
        found = np.full((len(x), probed, m), -9, np.float32)
        names = np.zeros((len(x), probed, m), np.int32)
        for g, members in enumerate(self.groups):
            r, slot = np.nonzero(near == g)
            if len(r) and len(members):
                s = x[r] @ self.rows[members].T
                take = min(m, len(members))
                top = np.argpartition(-s, take - 1, axis=1)[:, :take]
                found[r, slot, :take], names[r, slot, :take] = np.take_along_axis(s, top, 1), members[top]
        found, names = found.reshape(len(x), -1), names.reshape(len(x), -1)
        order = np.argsort(-found, axis=1, kind="stable")[:, :m]
        found, names = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)
        short = np.flatnonzero(found[:, -1] <= -9)  # the groups probed hold too few
        if len(short):
            s = x[short] @ self.rows.T
            order = np.argsort(-s, axis=1, kind="stable")[:, :m]
            found[short], names[short] = np.take_along_axis(s, order, 1), order
        return names, found


def _files(orders: np.ndarray, place: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and file of each posting under the pivot at ``place`` of the rows' orders.

    A row under a hot pivot goes to the parts of the first NEXT other pivots of its order.
    """
    pivot = orders[:, place].astype(np.int64)
    others = [q for q in range(orders.shape[1]) if q != place][:NEXT]
    split = np.flatnonzero(hot[pivot]) if others else np.zeros(0, np.int64)
    plain = np.setdiff1d(np.arange(len(pivot)), split)
    rows = np.concatenate([plain, *[split] * len(others)]) if len(split) else plain
    files = np.concatenate([pivot[plain], *((pivot[split] + 1) * 65_536 + orders[split, q] for q in others)]) if len(split) else pivot
    return rows, files


def _postings(shared, dims: int, k: int, exact: bool):
    """(id, embedding) -> one row per inverted file: file, id, hash, order, packed difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, hot = shared.value
        for batch in batches:
            ok, x = unit_rows(batch.column(1), dims)
            if not len(ok):
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)[ok]
            h = vector_hash(x)
            # the k + 1 smallest ids of each class within this batch; an id counts once
            order = np.lexsort((ids, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (ids[order][1:] != ids[order][:-1])]
            order = order[new]
            head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
            place = np.arange(len(order)) - np.repeat(head, np.diff(np.r_[head, len(order)]))
            keep = np.sort(order[place <= k])
            for a in range(0, len(keep), 2_048):
                at = keep[a : a + 2_048]
                rows, sim = pivots.orders(x[at], PREFIX)
                for p in range(min(POSTED, rows.shape[1])):
                    of, file = _files(rows, p, hot)
                    pivot = rows[of, p]
                    rest = x[at[of]] - pivots.rows[pivot]
                    if exact:
                        scale, packed = np.ones(len(of), np.float32), rest.astype(np.float32)
                    else:
                        scale = np.abs(rest).max(1) / 127 + np.float32(1e-12)
                        packed = np.rint(rest / scale[:, None]).astype(np.int8)
                    raw = packed.view(np.uint8).ravel()
                    width = packed.itemsize * dims
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file), pa.array(ids[at[of]]), pa.array(h[at[of]].view(np.int64)),
                            pa.array(scale), pa.array(sim[of, p]),
                            pa.FixedSizeListArray.from_arrays(pa.array(rows[of].ravel().astype(np.int16)), rows.shape[1]).cast(pa.list_(pa.int16())),
                            pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((np.arange(len(of) + 1) * width).astype(np.int32)), pa.py_buffer(raw)]),
                        ],
                        names=["file", "id", "h", "scale", "along", "ord", "vec"],
                    )

    return run


def _common(order: np.ndarray, q: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Similarity by footrule of members ``q`` with all: the sum over common pivots of the smaller
    weight.  The footrule distance is a constant less twice that."""
    out = np.zeros((len(q), len(order)), np.int8)  # 78 at most
    for w in weights[np.unique(order[q])]:
        mine = w[q]
        rows = np.flatnonzero(mine)
        if 2 * len(rows) > len(q):
            out += np.minimum(mine[:, None], w[None, :])
        else:
            out[rows] += np.minimum(mine[rows][:, None], w[None, :])
    return out


class _File:
    """Members of one inverted file: ids, hashes, packed differences from the pivot and their
    scales, and similarities to the pivot, which has length one."""

    def __init__(self, ids, h, scale, along, vec, k: int, file_rows: int):
        self.ids, self.h, self.scale, self.along, self.vec = ids, h, scale, along, vec
        self.k, self.file_rows = k, file_rows

    def rest(self, rows: np.ndarray) -> np.ndarray:
        return self.vec[rows].astype(np.float32) * self.scale[rows][:, None]

    def members(self) -> np.ndarray:
        """The rows of the k + 1 smallest ids of each class, each once."""
        o = np.lexsort((self.ids, self.h))
        h, ids = self.h[o], self.ids[o]
        o = o[np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])]]
        h = self.h[o]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        place = np.arange(len(o)) - np.repeat(head, np.diff(np.r_[head, len(o)]))
        return np.sort(o[place <= self.k])

    def nearest(self, rows: np.ndarray, order: np.ndarray, depth: int = 0):
        """k nearest of each of ``rows`` among them: (row, row, similarity)."""
        if len(rows) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(rows) > self.file_rows and depth < 4:
            return self.divided(rows, order, depth)
        return self.ranked(rows, order)

    def divided(self, rows: np.ndarray, order: np.ndarray, depth: int):
        """As ``nearest``, through pivots drawn among the members."""
        n = len(rows)
        drawn = rows[np.argsort(tc.mix(self.ids[rows].view(np.uint64) + np.uint64(depth)), kind="stable")[: max(2 * POSTED, min(MAX_PIVOTS, n // CELL))]]
        # x.y = (p + r).(p + s) with p.r = along - 1: the pivot's part goes into one more number
        wide = lambda at, last: np.concatenate([self.rest(at), last[:, None]], axis=1)
        pivots = Pivots(wide(drawn, self.along[drawn]))
        inner = np.concatenate([pivots.orders(wide(rows[a : a + 2_048], np.ones(len(rows[a : a + 2_048]), np.float32)), PREFIX)[0] for a in range(0, n, 2_048)])
        posted = inner[:, :POSTED]
        by = np.argsort(posted.ravel(), kind="stable")
        file, member = posted.ravel()[by], by // posted.shape[1]
        ends = np.r_[np.flatnonzero(np.r_[True, file[1:] != file[:-1]]), len(file)]
        parts = []
        for s, e in zip(ends[:-1], ends[1:]):
            m = member[s:e]
            parts.append(self.nearest(rows[m], inner[m], depth + 1) if 10 * len(m) < 7 * n else self.ranked(rows[m], inner[m]))
        q, c, sim = (np.concatenate(v) for v in zip(*parts))
        # the best k of each, each other once
        o = np.lexsort((self.ids[c], -np.round(sim, 9), q))
        q, c, sim = q[o], c[o], sim[o]
        new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)  # equal pairs have equal similarities
        q, c, sim = q[new], c[new], sim[new]
        head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        best = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)])) < self.k
        return q[best], c[best], sim[best]

    def ranked(self, rows: np.ndarray, order: np.ndarray):
        """As ``nearest``: footrule over all members, cosine over the best RERANK."""
        n, m = order.shape
        rest, a, ids, h = self.rest(rows), self.along[rows].astype(np.float32), self.ids[rows], self.h[rows]
        names, local = np.unique(order, return_inverse=True)
        local = local.reshape(n, m)
        weights = np.zeros((len(names), n), np.int8)
        for r in range(m):
            weights[local[:, r], np.arange(n)] = m - r
        out_q, out_c, out_s = [], [], []
        for b in range(0, n, 512):
            q = np.arange(b, min(n, b + 512))
            common = _common(local, q, weights)
            common[np.arange(len(q)), q] = -1
            size = min(RERANK, n - 1)
            cand = np.argpartition(-common, size - 1, axis=1)[:, :size]
            cos = _dots(rest, q, cand) + (a[q][:, None] + a[cand] - 1)
            cos = np.minimum(cos, BELOW_ONE)
            cos[h[cand] == h[q][:, None]] = 1.0
            take = min(self.k, size)
            # equal similarities at nine decimals: the smaller id
            best = np.lexsort((ids[cand], -np.round(cos, 9)), axis=1)[:, :take]
            out_q.append(np.repeat(q, take))
            out_c.append(np.take_along_axis(cand, best, 1).ravel())
            out_s.append(np.take_along_axis(cos, best, 1).ravel())
        q, c, s = np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)
        return rows[q], rows[c], s


def _dots(x: np.ndarray, q: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Products of each query with its candidates; all products where that is as cheap."""
    if len(x) <= 4 * cand.shape[1]:
        return np.take_along_axis(x[q] @ x.T, cand, 1)
    out = np.empty(cand.shape, np.float32)
    for i, row in enumerate(q):
        out[i] = x[cand[i]] @ x[row]
    return out


def _search(dims: int, k: int, exact: bool, file_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:  # sorted by file; a file may go over several batches
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            file = rest["file"].to_numpy()
            done = int(np.searchsorted(file, file[-1]))
            if done:
                yield from files(rest.slice(0, done))
                rest = rest.slice(done)
        if rest is not None and len(rest):
            yield from files(rest)

    def files(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        file, ids, h = (t[c].to_numpy() for c in ("file", "id", "h"))
        scale, along = t["scale"].to_numpy(), t["along"].to_numpy()
        lists = t["ord"].chunk(0)
        order = lists.flatten().to_numpy().reshape(len(file), -1)
        raw = t["vec"].chunk(0)
        begin = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
        kind = np.float32 if exact else np.int8
        vec = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + len(file) * dims * np.dtype(kind).itemsize].view(kind).reshape(len(file), dims)
        ends = np.r_[np.flatnonzero(np.r_[True, file[1:] != file[:-1]]), len(file)]
        qs, cs, ss = [], [], []
        for s, e in zip(ends[:-1], ends[1:]):
            one = _File(ids[s:e], h[s:e], scale[s:e], along[s:e], vec[s:e], k, file_rows)
            members = one.members()
            q, c, sim = one.nearest(members, order[s:e][members])
            qs.append(ids[s + q])
            cs.append(ids[s + c])
            ss.append(sim)
        if qs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(qs)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(ss).astype(np.float64))], names=["q", "c", "s"]
            )

    return run


def _equal_ids(source: DataFrame, dims: int, k: int) -> DataFrame | None:
    """(q, c, s = 1): the k smallest other ids equal to an id at nine decimals, of the ids whose
    class is cut or equal to another one; None if there are none."""
    spark = source.sparkSession
    hashes = cut(source.mapInArrow(_hashes(dims), "id bigint, h bigint, cells array<bigint>"))
    celled = hashes.select("h", F.explode("cells").alias("cell"))
    crowded = celled.groupBy("cell").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("cell")
    suspects = celled.join(crowded, "cell", "left_semi").select("h").distinct()
    chosen = hashes.join(suspects, "h", "left_semi").groupBy("h").agg(F.min("id").alias("id")).select("id")
    wanted = chosen.limit(MAX_IDS + 1).toArrow()["id"].to_numpy()
    large = hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    equal = large.select("h", F.col("h").alias("other"))
    if len(wanted):
        shared = spark.sparkContext.broadcast(np.sort(wanted)) if len(wanted) <= MAX_IDS else None
        some = source if shared is not None else source.join(chosen.distinct(), "id", "left_semi")
        found = some.mapInArrow(_celled(shared, dims), "cell bigint, id bigint, h bigint, v array<float>")
        found = found.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_equal(dims, k), "h bigint, other bigint")
        equal = equal.unionByName(found.where("h <> other")).unionByName(found.where("h <> other").select("h", F.col("h").alias("other")))
    equal = cut(equal.distinct())
    if equal.isEmpty():
        return None
    # of the classes that stand in equal: the k + 1 smallest ids of each, then of all equal to it
    members = hashes.select("id", "h").join(equal.select("h").union(equal.select("other")).distinct(), "h", "left_semi").distinct()
    smallest = lambda rows: rows.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("c"))).where(F.col("r") <= k + 1).drop("r")
    first = smallest(members.withColumnRenamed("id", "c"))
    first = smallest(equal.join(first.withColumnRenamed("h", "other"), "other").select("h", "c"))
    return members.join(first, "h").where("id <> c").select(F.col("id").alias("q"), "c", F.lit(1.0).alias("s"))


def _pivots(source: DataFrame, rows: int, wanted: int, dims: int) -> np.ndarray:
    """``wanted`` usable vectors that differ, or all where there are fewer: those of the smallest
    hashed ids, so the same in every run."""
    order, most = F.xxhash64("id", F.lit(17)), wanted + wanted // 4
    share = max(1, rows // (2 * wanted))
    for kept in (source.where(F.pmod(order, F.lit(share)) == 0), source):  # all, where hardly any row is usable
        sample = kept.mapInArrow(_usable(dims), "id bigint, v array<float>").orderBy(order, "id").limit(most).toArrow()["v"]
        _, x = unit_rows(sample.combine_chunks() if sample.num_chunks != 1 else sample.chunk(0), dims)
        one = np.unique(vector_hash(x), return_index=True)[1] if len(x) else np.zeros(0, np.int64)
        if share == 1 or len(one) >= min(MIN_PIVOTS, wanted):
            break
    return x[one][:wanted]


def nearest(
    df: DataFrame, k: int = 10, dims: int = 768, id_col: str = "id", vec_col: str = "embedding", exact: bool = False,
    cell: int = CELL, max_pivots: int = MAX_PIVOTS, file_rows: int = FILE_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(id, other, similarity): the k most similar other ids of each id with a usable vector.

    A vector is usable if it holds ``dims`` finite numbers that are not all zero; others, null
    vectors and null ids have no row.  An id delivered twice counts once (its rows are taken to
    be equal).  Equal similarities go by the smaller id; those that are 1 at nine decimals
    are found in float64, one vector standing for all of one hash.  Other columns are not read; an empty
    table gives no rows.  The result is approximate: see the README for the measured recall.
    """
    spark = df.sparkSession
    source = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")
    )
    rows = max(1, df.count())
    pivots = _pivots(source, rows, max(MIN_PIVOTS, min(max_pivots, rows // cell)), dims)
    if not len(pivots):
        return spark.createDataFrame([], "id bigint, other bigint, similarity double")
    index = Pivots(pivots)
    # members of each file, from the pivots' own orders (each is the first of its own)
    posted = index.orders(pivots, POSTED + 1)[0][:, 1:] if len(pivots) > POSTED else np.arange(len(pivots))
    members = np.bincount(posted.ravel(), minlength=len(pivots)) * (rows / len(pivots))
    shared = spark.sparkContext.broadcast((index, members > task_rows))

    schema = "file bigint, id bigint, h bigint, scale float, along float, ord array<smallint>, vec binary"
    postings = source.mapInArrow(_postings(shared, dims, k, exact), schema)
    near = postings.repartition("file").sortWithinPartitions("file").mapInArrow(_search(dims, k, exact, file_rows), "q bigint, c bigint, s double")

    equal = _equal_ids(source, dims, k)
    near = near if equal is None else near.unionByName(equal)
    best = (
        near.repartition("q")
        .groupBy("q", "c")
        .agg(F.max("s").alias("s"))
        .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.round("s", 9).desc(), "c")))
        .where(F.col("r") <= k)
    )
    return best.select(F.col("q").alias("id"), F.col("c").alias("other"), F.col("s").alias("similarity"))


def neighbour_pairs(df: DataFrame, k: int = 10, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other."""
    n = nearest(df, k, **options)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
