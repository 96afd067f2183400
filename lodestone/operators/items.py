"""Line items of notes: extraction, scoring and what follows from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.sources.notes import MEMORY_FILE

PROMOTE, ARCHIVE = 2.0, 0.05
LEAST = 15


def note_lines(notes: DataFrame) -> DataFrame:
    """(source, day, chunk, part, line, section, raw, stripped) of notes (source, day, chunk, content).

    Null contents have no line.
    """
    return notes.select("source", "day", "chunk", F.explode(fx.lines(F.col("content"))).alias("x")).select(
        "source", "day", "chunk", "x.part", "x.line", "x.section", F.col("x.text").alias("raw"), fx.strip(F.col("x.text")).alias("stripped")
    )


def extract_items(notes: DataFrame) -> DataFrame:
    """Items: lines that are no noise and long enough before and after formatting is taken off.

    Columns source, day, chunk, part, line, section (lower case), text (200 characters),
    text_key, category, entities; keys, category and entities come from the whole line.
    """
    lines = note_lines(notes).where((F.length("stripped") >= LEAST) & ~F.col("stripped").rlike(f"(?dU){fx.NOISE}"))
    clean = lines.withColumn("clean", fx.plain(F.col("stripped"))).where(F.length("clean") >= LEAST)
    return clean.select(
        "source", "day", "chunk", "part", "line", F.lower("section").alias("section"),
        F.substring("clean", 1, 200).alias("text"), fx.text_key(F.col("clean")).alias("text_key"),
        fx.category(F.col("clean")).alias("category"), fx.entities(F.col("clean")).alias("entities"),
    )


def _place() -> Column:
    """Order of first occurrence: MEMORY.md, then by file and line."""
    return F.struct((F.col("source") != MEMORY_FILE).alias("late"), F.col("source"), F.col("chunk"), F.col("part"), F.col("line"))


def dedup_items(items: DataFrame) -> DataFrame:
    """The first item of each text_key, with the number of days its key occurs on.

    One aggregation: it combines before the shuffle, so a key in very many notes is no burden.
    """
    keep = ("source", "day", "section", "text", "category", "entities")
    return (
        items.groupBy("text_key")
        .agg(F.min_by(F.struct(*keep), _place()).alias("x"), F.count_distinct("day").alias("frequency"))
        .select("text_key", "x.*", "frequency")
    )


def score_items(items: DataFrame, as_of: Column, threshold: float = 0.0) -> DataFrame:
    """Deduplicated items with their score; those below the threshold are left out."""
    s = fx.score(F.col("category"), F.col("day"), as_of, F.col("frequency"), F.size("entities"), F.col("text"))
    return dedup_items(items).withColumn("score", s).where(F.col("score") >= threshold)


def ranked(scored: DataFrame, n: int | None = None) -> DataFrame:
    """By score; equal scores by text_key."""
    order = scored.orderBy(F.desc("score"), "text_key")
    return order.limit(n) if n else order


def _public(*left_out: str) -> list[Column]:
    columns = {"hash": fx.short_hash(F.col("text")), "score": F.col("score"), "category": F.col("category"), "source": F.col("source"), "date": F.col("day").cast("string"), "frequency": F.col("frequency")}
    return [c.alias(name) for name, c in columns.items() if name not in left_out]


def public(scored: DataFrame) -> DataFrame:
    """What may leave the workspace: a hash in place of the text."""
    return scored.select(*_public())


def promotions(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("score") >= PROMOTE) & (F.col("source") != MEMORY_FILE))


def archive_candidates(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score") < ARCHIVE)


def report(scored: DataFrame, previous_total: int | None = None) -> DataFrame:
    """One row: what the scores follow from, totals, items per category, and the first 50 items, 20
    promotions and 20 archive candidates, by score."""
    one = lambda df: df.withColumn("one", F.lit(1))

    def first(df: DataFrame, name: str, n: int, *left_out: str) -> DataFrame:
        top = ranked(df, n).select((-F.col("score")).alias("o"), "text_key", F.struct(*_public(*left_out)).alias("x"))
        rows = F.sort_array(F.collect_list(F.struct("o", "text_key", "x")))
        return one(top.agg(F.transform(rows, lambda r: r["x"]).alias(name)))

    config = F.struct(
        F.lit(fx.HALF_LIFE_DAYS).alias("half_life_days"), F.lit(fx.SCORE_CAP).alias("max_score"),
        F.create_map(*(F.lit(x) for pair in fx.CATEGORY_WEIGHTS.items() for x in pair)).alias("category_weights"),
        F.lit(1 + fx.FREQUENCY_STEP).alias("frequency_boost_base"), F.lit(PROMOTE).alias("promote_threshold"), F.lit(ARCHIVE).alias("archive_threshold"),
    )
    kinds = scored.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("category_distribution"))
    return (
        one(score_stats(scored, previous_total)).join(one(kinds), "one")
        .join(first(scored, "top_items", 50), "one").join(first(promotions(scored), "promoted", 20), "one")
        .join(first(archive_candidates(scored), "archive", 20, "category", "frequency"), "one")
        .withColumn("config", config).drop("one")
    )


def score_stats(scored: DataFrame, previous_total: int | None = None) -> DataFrame:
    """One row of totals, also for no items; delta is null without an earlier run."""
    delta = F.lit(None).cast("bigint") if previous_total is None else F.count("*") - F.lit(previous_total)
    return scored.agg(
        F.count("*").alias("total_items"),
        F.count_if((F.col("score") >= PROMOTE) & (F.col("source") != MEMORY_FILE)).alias("promotions"),
        F.count_if(F.col("score") < ARCHIVE).alias("archive_candidates"),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_score"),
        F.round(F.coalesce(F.max("score"), F.lit(0.0)), 4).alias("max_score_seen"),
        delta.alias("delta_from_previous"),
    )
