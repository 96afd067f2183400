"""Lexical, vector and hybrid search over memories.

Every ranking ends in the id, so ties have one order.  Lists are cut to a pool by top-k before
they meet; all that follows works on at most two pools of rows, which is what is broadcast.  A search
reads the memories once to rank them and once for the details of its pools.
"""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import cut

K1, B = 1.2, 0.75
RRF_K, NOISE_FLOOR = 60, 0.015

_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def fold(c: Column) -> Column:
    """Lower case without diacritics; letters that are no base with marks (ß, ø) stay."""
    return F.lower(F.regexp_replace(F.translate(c, "".join(_ACCENTED), _BASES), r"\p{M}+", ""))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(query: str) -> list[list[str]]:
    """Each blank-separated term, without operators and the word NEAR, as a phrase of tokens."""
    # Fixed value: the characters and the word that are operators of a query
    cleaned = re.sub(r'["*()+\-:\[\]{}^~/=!@#]', " ", query)
    cleaned = re.sub(r"\bNEAR\b", " ", cleaned, flags=re.I)
    plain = lambda t: "".join(ch for ch in unicodedata.normalize("NFD", t) if not unicodedata.combining(ch)).lower()
    phrases = [[w for w in re.split(r"[\W_]+", plain(t)) if w] for t in cleaned.split()]
    return [p for p in phrases if p]


def _tf(toks: Column, phrase: list[str]) -> Column:
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    m = len(phrase)
    want = F.array(*map(F.lit, phrase))
    starts = F.when(F.size(toks) >= m, F.sequence(F.lit(1), F.size(toks) - (m - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(toks, i, m) == want))


def one_per_id(memories: DataFrame, *columns: Column | str) -> DataFrame:
    """Memories without repeated deliveries: rows of one id are equal, so any of them.

    With ``columns``, the id and these, computed before rows are brought together, so that what is
    long stays where it is.
    """
    rows = memories.where(F.col("id").isNotNull())
    return (rows.select("id", *columns) if columns else rows).dropDuplicates(["id"])


LEXICAL = "query string, id bigint, source string, bm25 double, lex_rank int"


def lexical_many(memories: DataFrame, queries: list[str], limit: int) -> DataFrame:
    """(query, id, source, bm25, lex_rank): for each query the memories that hold every phrase of
    it, lowest score first.

    One pass over the memories counts all phrases; only counts are deduplicated and kept.  A query
    without a token gives no rows, as does an empty table; null contents hold nothing.
    """
    spark = memories.sparkSession
    wanted = {q: query_phrases(q) for q in dict.fromkeys(queries)}
    phrases = list(dict.fromkeys(tuple(p) for q in wanted.values() for p in q))
    empty = spark.createDataFrame([], LEXICAL)
    if not phrases:
        return empty
    tf = {p: f"tf{i}" for i, p in enumerate(phrases)}
    counted = memories.where("id is not null and content is not null").select("id", "source", tokens(F.col("content")).alias("t"))
    counted = counted.select("id", "source", F.size("t").alias("len"), *(_tf(F.col("t"), list(p)).alias(n) for p, n in tf.items()))
    counted = cut(counted.dropDuplicates(["id"]))  # rows of one id are equal
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(n) > 0).alias(n) for n in tf.values())).first()
    if not stats.n or not stats.avg:
        return empty
    out = None
    for query, own in wanted.items():
        if not own:
            continue
        score, held = F.lit(0.0), F.lit(True)
        for p in own:
            name = tf[tuple(p)]
            df = stats[name]
            idf = float(np.log((stats.n - df + 0.5) / (df + 0.5)))
            f = F.col(name).cast("double")
            score = score - F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(stats.avg)))
            held = held & (F.col(name) > 0)
        hits = counted.where(held).select(F.lit(query).alias("query"), "id", "source", score.alias("bm25")).orderBy("bm25", "id").limit(limit)
        hits = hits.withColumn("lex_rank", F.row_number().over(Window.orderBy("bm25", "id")))
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else empty


def lexical_search(memories: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, source, bm25, lex_rank) of one query; see lexical_many."""
    return lexical_many(memories, [query], limit).drop("query")


def _distances(query: np.ndarray, metric: str, limit: int):
    """The ``limit`` nearest ids of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            v = batch.column(1)
            offsets = v.offsets.to_numpy()
            values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = np.flatnonzero((np.diff(offsets) == len(query)) & v.is_valid().to_numpy(zero_copy_only=False))
            x = values[offsets[ok][:, None] + np.arange(len(query))]
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            ok, x = ok[good], x[good]
            if metric == "l2":
                d = np.sqrt(((x - query) ** 2).sum(1))
            else:
                d = 1 - (x @ query) / (np.sqrt((x * x).sum(1)) * np.sqrt(query @ query))
            ids, best = np.concatenate([ids, batch.column(0).to_numpy(zero_copy_only=False)[ok]]), np.concatenate([best, d])
            order = np.lexsort((ids, np.round(best, 9)))
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:limit]  # an id once
            ids, best = ids[order], best[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], names=["id", "distance"])

    return run


def nearest_ids(vectors: DataFrame, query: list[float], limit: int, metric: str = "l2") -> DataFrame:
    """(id, distance) of the ``limit`` vectors nearest to the query vector (l2 or cosine).

    Unusable vectors (null, other length, NaN, all zero) and null ids are left out.  Each task
    sends on its best ``limit`` only.
    """
    q = np.array(query, np.float64)
    near = vectors.where("id is not null").select("id", F.col("embedding").cast("array<float>"))
    near = near.mapInArrow(_distances(q, metric, limit), "id bigint, distance double")
    return near.groupBy("id").agg(F.min("distance").alias("distance")).orderBy(F.round("distance", 9), "id").limit(limit)


def details_of(pool: DataFrame, memories: DataFrame, *columns: str) -> DataFrame:
    """(id, columns) of the memories of a pool of ids, each once; the pool is small and broadcast."""
    held = memories.where("id is not null").join(F.broadcast(pool.select("id").distinct()), "id", "left_semi")
    return held.groupBy("id").agg(F.max(F.struct(*columns)).alias("m")).select("id", "m.*")


def _ranked(near: DataFrame, details: DataFrame) -> DataFrame:
    top = near.join(F.broadcast(details.select("id", "source")), "id").select("id", "source", "distance")
    return top.withColumn("vec_rank", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")))


def vector_search(vectors: DataFrame, memories: DataFrame, query: list[float], limit: int, metric: str = "l2") -> DataFrame:
    """(id, source, distance, vec_rank): the memories of the ``limit`` nearest vectors.  A vector
    without a memory takes a place among the nearest and then has no row."""
    near = cut(nearest_ids(vectors, query, limit, metric))
    return _ranked(near, details_of(near, memories, "source"))


def query_vector(vectors: DataFrame, hits: DataFrame) -> list[float] | None:
    """The vector of the best lexical hit that has a usable one: a stand-in for an embedding model."""
    ranks = {r.id: r.lex_rank for r in hits.select("id", "lex_rank").collect()}  # at most a pool
    rows = vectors.where(F.col("id").isin(*ranks)).select("id", "embedding").collect() if ranks else []
    usable = [r for r in rows if r.embedding and len(r.embedding) == 768 and all(np.isfinite(r.embedding)) and any(r.embedding)]
    return min(usable, key=lambda r: ranks[r.id]).embedding if usable else None


def fuse(lexical: DataFrame, vector: DataFrame, floor: float = NOISE_FLOOR) -> DataFrame:
    """(id, source, lex_rank, vec_rank, rrf): reciprocal ranks of both lists added, from ``floor`` up."""
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    both = lexical.select("id", "lex_rank", F.col("source").alias("s1")).join(
        vector.select("id", "vec_rank", F.col("source").alias("s2")), "id", "full_outer"
    )
    return both.select("id", F.coalesce("s1", "s2").alias("source"), "lex_rank", "vec_rank", (part("lex_rank") + part("vec_rank")).alias("rrf")).where(
        F.col("rrf") >= floor
    )


def boost(fused: DataFrame, memories: DataFrame) -> DataFrame:
    """Adds ``boosted``: rrf * (1 + score / 10), the score relative to the best among the fused."""
    joined = fused.join(details_of(fused, memories, "score"), "id", "left")
    most = F.coalesce(F.nullif(F.max("score").over(Window.partitionBy()), F.lit(0.0)), F.lit(1.0))  # at most two pools of rows
    return joined.withColumn("boosted", F.col("rrf") * (1 + 0.1 * F.coalesce("score", F.lit(0.0)) / most)).drop("score")


def best_per_source(fused: DataFrame) -> DataFrame:
    """The best row of each source; rows without a source all stay."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("rrf"), "id"))
    return fused.withColumn("r", rank).where("r = 1 or source is null or source = ''").drop("r")


def hybrid_search(
    memories: DataFrame, vectors: DataFrame, query: str, limit: int = 10, vector: list[float] | None = None,
    metric: str = "l2", dedup: bool = True, floor: float = NOISE_FLOOR, details: tuple[str, ...] = (),
) -> DataFrame:
    """The ``limit`` best memories by fused rank, best first (the boost doesn't reorder), with the
    columns of ``details`` of each."""
    pool = max(4 * limit, 20)
    lexical = lexical_search(memories, query, pool)
    vector = vector or query_vector(vectors, lexical)
    if vector is None:
        near = memories.sparkSession.createDataFrame([], "id bigint, distance double")
    else:
        near = nearest_ids(vectors, vector, pool, metric)
    both = cut(lexical.select("id", "lex_rank", F.lit(None).cast("double").alias("distance")).unionByName(near.withColumn("lex_rank", F.lit(None).cast("int"))))
    known = cut(details_of(both, memories, "source", "score", *details))  # at most two pools
    near = _ranked(both.where("distance is not null").select("id", "distance"), known)
    lexical = both.where("lex_rank is not null").join(F.broadcast(known.select("id", "source")), "id").select("id", "source", "lex_rank")
    fused = boost(fuse(lexical, near, floor), known)
    found = (best_per_source(fused) if dedup else fused).orderBy(F.desc("rrf"), "id").limit(limit)
    return found.join(F.broadcast(known.select("id", *details)), "id").orderBy(F.desc("rrf"), "id") if details else found


def with_details(found: DataFrame, memories: DataFrame, most: int = 300) -> DataFrame:
    """Adds the first ``most`` characters of the content, the category and the layer to a result:
    300 in results, 200 in JSON, 150 on a console."""
    return found.join(details_of(found, memories, "content", "category", "layer"), "id", "left").withColumn("content", F.substring("content", 1, most))


def store_stats(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: memories, sources, usable ids with a vector, latest creation."""
    one = one_per_id(memories, "source", "created_at").agg(
        F.count("*").alias("memories"), F.count_distinct("source").alias("sources"), F.max("created_at").alias("latest")
    )
    held = vectors.where("id is not null and embedding is not null").agg(F.count_distinct("id").alias("vectors"))
    return one.withColumn("one", F.lit(1)).join(held.withColumn("one", F.lit(1)), "one").drop("one")


def breakdown(memories: DataFrame, column: str) -> DataFrame:
    """Memories per value of a column, most first; values differ by more than case, nulls are one."""
    return one_per_id(memories, F.lower(column).alias(column)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


@F.pandas_udf(T.BinaryType())
def _packed(v: pd.Series) -> pd.Series:
    return v.map(lambda x: np.asarray(x, "<f4").tobytes(), na_action="ignore")


def packed(vector: Column) -> Column:
    """The numbers of a vector as bytes, four each, little-endian: for stores that keep vectors so."""
    return _packed(vector.cast("array<float>"))


def try_out(memories: DataFrame, vectors: DataFrame, queries: tuple[str, ...], pool: int = 20, limit: int = 5) -> list[dict]:
    """What each query finds and how long it takes, for lexical, vector and hybrid search: totals,
    the first three sources, milliseconds, and how many sources the hybrid results have.

    A harness: each search is run for itself, and no more than a pool of rows comes back.
    """
    out = []
    for query in queries:
        found = {"query": query}

        def timed(name: str, search, n: int = 3) -> None:
            began = time.time()
            rows = search().collect()
            found[f"{name}_ms"] = round(1000 * (time.time() - began), 1)  # noqa: B023
            found[f"{name}_total"], found[name] = len(rows), [r.source for r in rows[:n]]  # noqa: B023

        timed("lexical", lambda: lexical_search(memories, query, pool).orderBy("lex_rank"))  # noqa: B023
        vector = query_vector(vectors, lexical_search(memories, query, pool))
        if vector is None:
            found |= {"vector_ms": None, "vector_total": 0, "vector": []}
        else:
            timed("vector", lambda: vector_search(vectors, memories, vector, pool).orderBy("vec_rank"))  # noqa: B023
        timed("hybrid", lambda: hybrid_search(memories, vectors, query, limit, vector), limit)  # noqa: B023
        out.append(found | {"hybrid_sources": len(set(found["hybrid"]))})
    return out


def mean_ms(tried: list[dict]) -> dict[str, float]:
    """Mean milliseconds of each kind of search, over the queries that had one."""
    kinds = {k: [t[f"{k}_ms"] for t in tried if t[f"{k}_ms"] is not None] for k in ("lexical", "vector", "hybrid")}
    return {k: round(sum(v) / len(v), 1) for k, v in kinds.items() if v}
