"""Long exact spans shared between records (problem 8).

Texts are cut into units, unit digests are grouped over all records, and what repeats is
reported, or removed behind its earliest occurrence, with the original offsets.

Lines or paragraphs as units miss a shared stretch that begins and ends inside a line, so
``shared_spans`` lets the content choose the units: of all k-grams in a window of ``length``
code points the one with the smallest hash (the last of equals) owns the window.  Windows with
equal content have equal owners, so grouping the owners' digests brings together all records
that can share a window.  Only units whose digest occurs in two records go on.  They carry the
text their windows cover, are grouped by digest again, and windows are compared by the hash of
their whole content.  No pair of records is ever built: a group costs as much as it has text.

Records with equal texts are settled first, by digest of the whole text: each is one span, and
one of them stands for all in the search.  Units in very many records (HOT) send single window
hashes through an ordinary aggregation, which combines before it shuffles.

``dedup_lines`` and ``without_repeats`` are the plain form: lines as units, the earliest ranked
occurrence kept, the rest removed, the places of what is left retained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textcodes as tc
from lodestone.session import cut

#: k-gram of which the smallest in a window owns it.
GRAM = 48
#: Records per unit from which its windows are aggregated one by one.
HOT = 2_000


def _owners(codes: np.ndarray, prefix: np.ndarray, begins: np.ndarray, length: int, gram: int):
    """Of the windows of all texts: owner position (in codes), first and last window start, text.

    One row per owner; its windows are consecutive.
    """
    n = len(codes)
    count = np.diff(begins) - length + 1
    if n < length or count.max(initial=0) <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    g = tc.gram_hash(prefix, gram)
    # value above, position (reversed) below: the minimum is the last of the smallest; the same
    # 32 bits decide in every batch, so equal windows have equal owners wherever they stand
    low = np.uint64(32)
    best = (g >> low << low) | (np.uint64(n) - np.arange(len(g), dtype=np.uint64))
    width, span = length - gram + 1, 1
    while span < width:
        step = min(span, width - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    text = np.repeat(np.arange(len(count)), np.maximum(count, 0))
    full = np.maximum(count, 0)
    start = begins[:-1][text] + np.arange(len(text)) - (np.cumsum(full) - full)[text]
    owner = n - (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    tail = np.r_[head[1:], len(owner)] - 1
    return owner[head], start[head], start[tail], text[head]


def _units(length: int, gram: int):
    """(doc, text) -> (digest, doc, first window): one row per unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            codes, begins = tc.codes_of(batch.column(1))
            for a, z in tc.chunks(begins):
                c, b = codes[begins[a] : begins[z]], begins[a : z + 1] - begins[a]
                prefix = tc.prefix_hash(c)
                owner, first, _, text = _owners(c, prefix, b, length, gram)
                digest = tc.span_hash(prefix, owner, owner + gram).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest), pa.array(ids[a + text]), pa.array((first - b[text]).astype(np.int32))],
                    names=["u", "d", "f"],
                )

    return run


def _contexts(length: int, gram: int):
    """(doc, text, firsts, hots) -> (digest, doc, first window, windows, text or null, hash).

    A unit of ``firsts`` gives one row with the text its windows cover, or, where it is hot, one
    row with the hash of each window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            codes, begins = tc.codes_of(batch.column(1))
            lists = batch.column(2)
            of = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            key = (of << 32) + flat.field(0).to_numpy()
            order = np.argsort(key)
            key, hot = key[order], flat.field(1).to_numpy(zero_copy_only=False)[order]
            for a, z in tc.chunks(begins):
                c, b = codes[begins[a] : begins[z]], begins[a : z + 1] - begins[a]
                prefix = tc.prefix_hash(c)
                owner, first, last, text = _owners(c, prefix, b, length, gram)
                place = first - b[text]
                mine = ((a + text) << 32) + place
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                wanted = np.flatnonzero(key[at] == mine)
                heat = hot[at[wanted]]
                k = wanted[~heat]
                if len(k):
                    n = last[k] - first[k] + 1
                    digest = tc.span_hash(prefix, owner[k], owner[k] + gram).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(digest), pa.array(ids[a + text[k]]), pa.array(place[k].astype(np.int32)), pa.array(n.astype(np.int32)),
                            tc.texts_of(c, first[k], n + length - 1), pa.nulls(len(k), pa.int64()),
                        ],
                        names=["u", "d", "f", "n", "t", "h"],
                    )
                k = wanted[heat]
                if len(k):
                    n = last[k] - first[k] + 1
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = np.repeat(first[k], n) + nth
                    h = tc.span_hash(prefix, start, start + length).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.zeros(len(h), np.int64)), pa.array(np.repeat(ids[a + text[k]], n)), pa.array((np.repeat(place[k], n) + nth).astype(np.int32)),
                            pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.string()), pa.array(h),
                        ],
                        names=["u", "d", "f", "n", "t", "h"],
                    )

    return run


def _compare(length: int):
    """Rows of whole units, sorted by digest -> (doc, first, windows) runs shared with another doc."""

    def settle(u, d, f, n, t):
        codes, begins = tc.codes_of(t)
        prefix = tc.prefix_hash(codes)
        row = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = begins[:-1][row] + offset
        h = tc.span_hash(prefix, start, start + length)
        order = np.argsort(h, kind="stable")
        doc = d[row][order]
        head = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        shared = np.zeros(len(row), bool)
        size = np.diff(np.r_[head, len(row)])
        shared[order] = np.repeat(np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head), size)
        at = np.flatnonzero(shared)
        if not len(at):
            return None
        cut = np.r_[True, (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])]
        a = at[np.flatnonzero(cut)]
        z = at[np.r_[np.flatnonzero(cut)[1:], len(at)] - 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(d[row[a]]), pa.array((f[row[a]] + offset[a]).astype(np.int64)), pa.array((z - a + 1).astype(np.int64))],
            names=["d", "f", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:  # a unit's rows may go over several batches
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            u = rest["u"].to_numpy()
            done = int(np.searchsorted(u, u[-1]))
            if done >= 4_000:
                yield from whole(rest.slice(0, done))
                rest = rest.slice(done)
        if rest is not None and len(rest):
            yield from whole(rest)

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        out = settle(
            table["u"].to_numpy(), table["d"].to_numpy(), table["f"].to_numpy().astype(np.int64),
            table["n"].to_numpy().astype(np.int64), table["t"].combine_chunks(),
        )
        if out is not None:
            yield out

    return run


def shared_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, hot: int = HOT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_start, span_len): the maximal spans of each text made up of stretches of
    ``length`` code points that also stand in the text of another record and that overlap or touch.

    Null, empty and shorter texts have no span; rows with a null id are left out; an id that is
    repeated with the same text counts once (ids are taken to name one text); other columns are
    not read; an empty table gives no rows.
    """
    gram = min(gram, length)
    source = docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= length)).select(
        F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")
    )
    whole = source.select("d", F.xxhash64("t").alias("x"), F.crc32("t").alias("y"), F.length("t").alias("len"))
    copies = whole.groupBy("x", "y", "len").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    copied = whole.join(copies, ["x", "y", "len"]).select("d", "len", "least").distinct()
    covered = copied.select("d", F.lit(0).cast("bigint").alias("s"), F.col("len").cast("bigint").alias("e"))
    stand_ins = copied.where("d <> least").select("d")  # all but one of each group of copies

    units = cut(source.mapInArrow(_units(length, gram), "u bigint, d bigint, f int").join(stand_ins, "d", "left_anti"))
    repeated = cut(
        units.groupBy("u").agg(F.min("d").alias("a"), F.max("d").alias("z"), F.count("*").alias("c"))
        .where("a < z")
        .select("u", (F.col("c") > hot).alias("hot"))
    )
    wanted = (
        units.join(repeated, "u")
        .groupBy("d")
        .agg(F.collect_list(F.struct("f", "hot")).alias("w"))  # at most one per position of one text
    )
    found = source.join(wanted, "d").mapInArrow(
        _contexts(length, gram), "u bigint, d bigint, f int, n int, t string, h bigint"
    )
    runs = (
        found.where("t is not null")
        .select("u", "d", "f", "n", "t")
        .repartition("u")
        .sortWithinPartitions("u")
        .mapInArrow(_compare(length), "d bigint, f bigint, n bigint")
    )
    if not repeated.where("hot").isEmpty():
        singles = found.where("h is not null").select("h", "d", "f")
        several = singles.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("z")).where("a < z").select("h")
        runs = runs.unionByName(singles.join(several, "h", "left_semi").select("d", F.col("f").cast("bigint").alias("f"), F.lit(1).cast("bigint").alias("n")))
    pieces = runs.select("d", F.col("f").alias("s"), (F.col("f") + F.col("n") + (length - 1)).alias("e"))
    return merge_spans(pieces.unionByName(covered), "d").select(
        F.col("d").alias(doc_id), F.col("s").alias("span_start"), (F.col("e") - F.col("s")).alias("span_len")
    )


def merge_spans(pieces: DataFrame, key: str) -> DataFrame:
    """Unites the pieces [s, e) of each key that overlap or touch."""
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        pieces.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
        .withColumn("g", F.sum("new").over(order))
        .groupBy(key, "g")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("g")
    )


def shared_share(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_spans, shared_chars, shared_share): per record how much of its text stands elsewhere.

    One row per distinct non-null id; texts without a span, empty ones included, have share 0.
    """
    spans = shared_spans(docs, length, doc_id=doc_id, text=text)
    per = spans.groupBy(doc_id).agg(F.count("*").alias("n_spans"), F.sum("span_len").alias("shared_chars"))
    size = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n"))
    return size.join(per, doc_id, "left").select(
        doc_id,
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.round(F.coalesce(F.col("shared_chars") / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)), 6).alias("shared_share"),
    )


def _lines(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(d, k, start, len, u): lines of ``min_chars`` normalised characters or more, with their number
    and digest; and (d, start) of the first of each digest.

    The first ones come from an aggregation that combines before it shuffles, and are joined by their
    own place, so that a line of very many texts is nobody's hot key.
    """
    lines = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.split(text, "\n").alias("l"))
    # places of lines without a shuffle: the sums of the lengths before them
    ends = F.aggregate(
        "l", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["s"], acc["at"]).alias("s")), lambda acc: acc["s"],
    )
    lines = lines.select("d", F.posexplode(F.arrays_zip(F.col("l").alias("l"), ends.alias("s"))).alias("k", "x")).select("d", "k", F.col("x.l").alias("line"), F.col("x.s").alias("start"))
    norm = F.trim(F.regexp_replace(F.lower("line"), r"(?U)\s+", " "))
    units = lines.select("d", "k", "start", F.length("line").alias("len"), F.md5(norm).alias("u"), F.length(norm).alias("n")).where(F.col("n") >= min_chars)
    first = units.groupBy("u").agg(F.min(F.struct("d", "start")).alias("first")).select("first.*")
    return units.drop("n"), first


def dedup_lines(docs: DataFrame, min_chars: int = 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_start, line_len, is_kept) of each line of ``min_chars`` normalised characters
    or more: kept where it is the first of its digest by (doc_id, line_start).

    Lines end at a newline; they are normalised by lower case and single spaces; offsets are code
    points of the text as it is.  Null and empty texts have no line, null ids are left out.
    """
    units, first = _lines(docs, min_chars, doc_id, text)
    return units.join(first.withColumn("kept", F.lit(True)), ["d", "start"], "left").select(
        F.col("d").alias(doc_id), F.col("start").cast("bigint").alias("line_start"), F.col("len").cast("bigint").alias("line_len"),
        F.coalesce("kept", F.lit(False)).alias("is_kept"),
    )


def without_repeats(docs: DataFrame, min_chars: int = 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, line_starts): each text without the lines that an earlier record, or the record
    itself further up, holds too; line_starts are the places of the lines left in the text as it was.

    Lines as in ``dedup_lines``; shorter ones stay.  A text of which nothing is left is empty, a
    null text stays null without places; null ids are left out; ids are taken to be unique.
    """
    units, first = _lines(docs, min_chars, doc_id, text)
    gone = units.join(first, ["d", "start"], "left_anti").groupBy("d").agg(F.collect_set("k").alias("gone"))  # no more than a text has lines
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.split(text, "\n").alias("l")).join(gone, "d", "left")
    places = F.aggregate(
        "l", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("s")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["s"], acc["at"]).alias("s")), lambda acc: acc["s"],
    )
    left = lambda a: F.when(F.col("gone").isNull(), a).otherwise(F.filter(a, lambda x, i: ~F.array_contains("gone", i)))
    return rows.select(F.col("d").alias(doc_id), F.array_join(left(F.col("l")), "\n").alias("text"), left(places).alias("line_starts"))
