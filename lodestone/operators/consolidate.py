"""Consolidation of daily notes: clusters over days, duplicates, promotions, stale items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators.items import LEAST, PROMOTE, note_lines
from lodestone.session import cut
from lodestone.sources.notes import MEMORY_FILE

STALE = 0.15
# How many promotions, stale items, duplicates and clusters a report names.
MOST_PROMOTIONS, MOST_STALE, MOST_DUPLICATES, MOST_CLUSTERS = 20, 10, 10, 10
#: Promotions that are looked for in one pass over MEMORY.md; more are joined.
PROBES = 1_000


def advisor_lines(notes: DataFrame, as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """(source, day, chunk, part, line, section, text) of lines long enough that are neither a
    fence nor a table row; with ``days``, of notes dated after as_of - days."""
    if days is not None:
        notes = notes.where(F.col("day") > F.date_sub(as_of, days))
    s = F.col("stripped")
    lines = note_lines(notes).where((F.length(s) >= LEAST) & ~s.startswith("```") & ~s.startswith("|"))
    return (
        lines.withColumn("clean", fx.plain(s))
        .where(F.length("clean") >= LEAST)
        .select("source", "day", "chunk", "part", "line", "section", F.substring("clean", 1, 200).alias("text"))
    )


def _place() -> Column:
    return F.struct("source", "chunk", "part", "line")


def clusters(lines: DataFrame, least_days: int = 2) -> DataFrame:
    """(key, n_items, dates, sources, sample_text, first, date_count): keys on ``least_days`` days or more.

    The arrays are sets of days and files per key; the lines themselves are not collected.
    """
    return (
        lines.withColumn("key", fx.cluster_key(F.col("text")))
        .where("key <> ''")
        .groupBy("key")
        .agg(
            F.count("*").alias("n_items"),
            F.sort_array(F.collect_set("day")).alias("dates"),
            F.sort_array(F.collect_set("source")).alias("sources"),
            F.min_by("text", _place()).alias("sample_text"),
            F.min(_place()).alias("first"),
        )
        .withColumn("date_count", F.size("dates"))
        .where(F.col("date_count") >= least_days)
    )


def top_clusters(lines: DataFrame, n: int = 10, least_days: int = 2) -> DataFrame:
    """The clusters on most days; equal ones by first appearance.

    All keys are counted without their days and files; only the lines of the ``n`` best go into arrays.
    """
    keyed = lines.withColumn("key", fx.cluster_key(F.col("text"))).where("key <> ''")
    counts = keyed.groupBy("key").agg(F.count_distinct("day").alias("days"), F.min(_place()).alias("first")).where(F.col("days") >= least_days)
    best = counts.orderBy(F.desc("days"), "first").limit(n).select("key")
    return clusters(keyed.join(F.broadcast(best), "key", "left_semi").drop("key"), least_days).orderBy(F.desc("date_count"), "first")


def line_stats(lines: DataFrame) -> DataFrame:
    """One row: lines, files and days."""
    return lines.agg(F.count("*").alias("n_lines"), F.count_distinct("source").alias("n_files"), F.count_distinct("day").alias("n_days"))


def summary_of(cluster_text: Column, summary: Column | None = None) -> Column:
    """A summary made elsewhere, or the first 80 characters of the sample."""
    start = F.substring(cluster_text, 1, 80)
    return start if summary is None else F.coalesce(F.nullif(summary, F.lit("")), start)


def _repeats(lines: DataFrame) -> DataFrame:
    """Each later line of a key whose first occurrence stands in another file, with its place.

    The notes are parsed once: lines with their keys are cut, the first of each key comes from an
    aggregation, which combines before it shuffles, and is joined.
    """
    keyed = cut(lines.withColumn("key", fx.cluster_key(F.col("text"))).select("key", "source", "day", "chunk", "part", "line", "text"))
    first = keyed.groupBy("key").agg(F.min(F.struct(_place().alias("p"), "source", "day")).alias("f"))
    return keyed.join(first, "key").where(F.col("source") != F.col("f.source")).withColumn("place", _place())


def duplicates(lines: DataFrame, n: int | None = None) -> DataFrame:
    """(text, source1, source2, date1, date2): each later line of a key whose first occurrence
    stands in another file; with ``n``, the first of them by file and line."""
    found = _repeats(lines)
    found = found if n is None else found.orderBy("place").limit(n)
    return found.select(
        F.substring("text", 1, 100).alias("text"), F.col("f.source").alias("source1"), F.col("source").alias("source2"),
        F.col("f.day").alias("date1"), F.col("day").alias("date2"),
    )


def advisor_promotions(scored: DataFrame, n: int | None = MOST_PROMOTIONS) -> DataFrame:
    """Promotions of the advisor: the best item of each cluster key, not from MEMORY.md, the best
    ``n`` of them (all for None)."""
    order = F.struct((-F.col("score")).alias("s"), "text_key")
    row = F.struct("text", "score", "category", "source", "day", "frequency", "text_key")
    best = (
        scored.where((F.col("score") >= PROMOTE) & (F.col("source") != MEMORY_FILE))
        .withColumn("key", fx.cluster_key(F.col("text")))
        .groupBy("key")
        .agg(F.min_by(row, order).alias("x"))
        .select("x.*")
    )
    return (best if n is None else best.orderBy(F.desc("score"), "text_key").limit(n)).drop("text_key")


def stale_items(scored: DataFrame, threshold: float = STALE, n: int | None = MOST_STALE) -> DataFrame:
    """Items of MEMORY.md that score below the threshold, the first ``n`` by score (all for None)."""
    found = scored.where((F.col("source") == MEMORY_FILE) & (F.col("score") < threshold))
    return (found if n is None else found.orderBy(F.desc("score"), "text_key").limit(n)).select("text", "score", "category")


def promotion_plan(promoted: DataFrame, memory: DataFrame, most: int = PROBES) -> DataFrame:
    """Promotions whose first 50 characters stand nowhere in MEMORY.md, whatever the case.

    ``memory`` holds its chunks (content).  As many promotions as the advisor gives are looked for
    in one pass over the chunks; more than ``most`` are joined to the windows of the lengths that
    occur, which are 51 at most, so that neither side is collected.
    """
    probes = promoted.withColumn("probe", F.lower(F.substring("text", 1, 50))).withColumn("n", F.length("probe"))
    few = [r.probe for r in probes.select("probe").where("probe is not null").distinct().limit(most + 1).collect()]
    lower = memory.where("content is not null").select(F.lower("content").alias("c"))
    if len(few) <= most:
        wanted = F.array(*map(F.lit, few)).cast("array<string>")
        held = lower.select(F.explode(F.filter(wanted, lambda p: F.contains(F.col("c"), p))).alias("probe")).distinct()
        return probes.join(held, "probe", "left_anti").drop("n", "probe")
    sizes = [r.n for r in probes.select("n").where("n is not null").distinct().collect()]
    windows = (
        lower.select("c", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("n"))
        .where(F.length("c") >= F.col("n"))
        .select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - F.col("n") + 1), lambda i: F.substring(F.col("c"), i, F.col("n")))).alias("probe"))
    )
    return probes.join(windows, ["n", "probe"], "left_anti").drop("n", "probe")


def recommendations(clusters_n: Column, promotions_n: Column, stale_n: Column, duplicates_n: Column) -> Column:
    """Array of the recommendations that apply, never empty."""
    found = F.array(
        F.when(clusters_n >= 3, F.lit("merge_clusters")),
        F.when(promotions_n >= 5, F.lit("promote_items")),
        F.when(stale_n >= 3, F.lit("trim_stale")),
        F.when(duplicates_n >= 2, F.lit("consolidate_duplicates")),
    )
    found = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("healthy")))


def report(lines: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: counts, the clusters, promotions, stale items and duplicates a report names, and
    the recommendations that follow.  Lines and scores are computed once."""
    lines, scored = cut(lines), cut(scored)
    one = lambda df: df.withColumn("one", F.lit(1))
    listed = lambda df, name, *by: one(df.agg(F.sort_array(F.collect_list(F.struct(*by, *(c for c in df.columns if c not in by)))).alias(name)))
    keys = lines.withColumn("key", fx.cluster_key(F.col("text"))).where("key <> ''").groupBy("key").agg(F.count_distinct("day").alias("days")).where("days >= 2")
    action = (F.lit("merge").alias("suggested_action"), F.lit("MEMORY.md (relevant section)").alias("suggested_target"))
    named = top_clusters(lines, MOST_CLUSTERS).select(
        (-F.col("date_count")).alias("order"), "first", "key", summary_of(F.col("sample_text")).alias("summary"), "date_count", "dates", "sources", "sample_text", *action
    )
    row = (
        one(lines.agg(F.count("*").alias("notes_analyzed"), F.count_distinct("source").alias("files_analyzed")))
        .join(one(keys.agg(F.count("*").alias("clusters_found"))), "one")
        .join(listed(named, "clusters", "order", "first"), "one")
        .join(listed(advisor_promotions(scored), "promotions", "text"), "one")
        .join(listed(stale_items(scored), "stale_items", "text"), "one")
        .join(listed(duplicates(lines, MOST_DUPLICATES), "duplicates", "source2"), "one")
    )
    row = row.withColumns({f"{c}_found": F.size(c) for c in ("promotions", "stale_items", "duplicates")})
    return row.withColumn("recommendations", recommendations(*(F.col(f"{c}_found") for c in ("clusters", "promotions", "stale_items", "duplicates")))).drop("one")


def cluster_items(lines: DataFrame, clusters: DataFrame, most: int = 5, items: int = 5) -> DataFrame:
    """(key, texts): the first ``items`` lines of each of the first ``most`` clusters, secrets
    redacted: what a summary is made from."""
    few = clusters.orderBy(F.desc("date_count"), "first").limit(most).select("key")
    mine = lines.withColumn("key", fx.cluster_key(F.col("text"))).join(F.broadcast(few), "key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(_place()))
    top = mine.withColumn("r", rank).where(F.col("r") <= items)
    return top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("r", fx.redact_secrets(F.col("text")).alias("t")))).alias("x")).select("key", F.col("x.t").alias("texts"))
