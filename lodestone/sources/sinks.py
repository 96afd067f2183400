"""Writing results: reports, snapshots of tables, archives and repairs.

Nothing is overwritten in place: a new snapshot goes to a path of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import health, ontology
from lodestone.operators import items as it
from lodestone.session import cut
from lodestone.sources.notes import MEMORY_FILE

#: Destructive runs over more than this many files need ``force``.
GUARD = 10


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines of a report as a new folder; fails if the folder is there."""
    df.write.mode("errorifexists").json(path)


def write_scores(scored: DataFrame, path: str, previous_total: int | None = None) -> None:
    """``report`` (one row) and ``all_scores`` under ``path``: hashes in place of texts."""
    scored = cut(scored)
    write_report(it.report(scored, previous_total), f"{path}/report")
    write_report(it.public(scored), f"{path}/all_scores")


def write_archive_candidates(scored: DataFrame, path: str) -> None:
    """The files of archive candidates, each once, with the number of its candidates."""
    candidates = it.archive_candidates(scored).where(F.col("source") != MEMORY_FILE)
    write_report(candidates.groupBy("source").agg(F.count("*").alias("n")), path)


def read_scores(spark, path: str) -> DataFrame:
    """all_scores of an earlier run; broken lines give nulls."""
    return spark.read.schema("hash string, score double, category string, source string, date string, frequency bigint").json(f"{path}/all_scores")


def append_memories(chunks: DataFrame, path: str) -> None:
    """Adds rows (id, content, category, layer, source, score) to the memories at ``path``.

    Appending again adds rows of the same ids (an id is a hash of source and place), which count
    once wherever memories are read, so a write that is repeated after a failure does no harm.
    """
    chunks.write.mode("append").parquet(path)


def create_store(memories: DataFrame, path: str, force: bool = False) -> None:
    """A new, empty store with the columns of ``memories``; an existing one only with ``force``."""
    memories.limit(0).write.mode("overwrite" if force else "errorifexists").parquet(path)


def archived(spark: SparkSession, path: str) -> DataFrame | None:
    """(destination) of the notes below an archive of archive_notes, None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).select("destination").distinct()


def archive_notes(notes: DataFrame, plan: DataFrame, path: str, force: bool = False) -> int:
    """Writes the planned notes (source, content) below month folders, and returns how many.

    What the archive holds is not written again.  More than GUARD notes need ``force``.
    """
    there = archived(plan.sparkSession, path)
    if there is not None:
        plan = plan.join(there, "destination", "left_anti")
    plan = cut(plan.select("source", "destination"))
    n = plan.count()
    if n > GUARD and not force:
        raise ValueError(f"{n} notes would be archived; more than {GUARD} need force")
    if n:
        moved = notes.select("source", "content").join(plan, "source").withColumn("month", F.date_format(F.to_date(F.substring("source", 1, 10)), "yyyy-MM"))
        moved.write.mode("append").partitionBy("month").parquet(path)
    return n


def fix_issues(notes: DataFrame, log: DataFrame, as_of: Column, path: str, dry_run: bool = False, force: bool = False) -> list[str]:
    """Archives notes (source, day, content) that are old by their name and repairs the log, both as new
    files below ``path``; what was done, or with ``dry_run`` would be.  Needs ``force`` otherwise."""
    if not (dry_run or force):
        raise ValueError("repairs need force")
    plan = cut(health.flat_archive_plan(notes, as_of))
    n, lines = plan.count(), log.count()
    sound = log.join(ontology.dedup_lines(log), "line_no", "left_semi")
    readable = ontology.sound_lines(log)
    unreadable, doubled = lines - readable.count(), readable.count() - sound.count()
    if not dry_run:
        notes.select("source", "content").join(plan, "source").write.mode("errorifexists").parquet(f"{path}/archive")
        repair_log(log, f"{path}/graph")
    return [
        text for count, text in (
            (n, f"archived {n} notes older than {health.NOTE_AGE} days"), (unreadable, f"left out {unreadable} unreadable lines of the log"), (doubled, f"left out {doubled} repeated lines of the log"),
        ) if count
    ]


def promote(memory: DataFrame, plan: DataFrame, path: str) -> None:
    """A new snapshot of MEMORY.md's chunks (id, content) with the planned texts appended."""
    last = memory.agg(F.max("id")).first()[0] or 0
    entries = plan.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "text")))  # a plan of promotions is short
    added = entries.select((F.col("r") + F.lit(last)).alias("id"), F.concat(F.lit("- "), "text").alias("content"))
    memory.select("id", "content").unionByName(added).write.mode("errorifexists").parquet(path)


def repair_log(log: DataFrame, path: str) -> None:
    """A new snapshot of the log with the lines a repair keeps."""
    log.join(ontology.dedup_lines(log), "line_no", "left_semi").write.mode("errorifexists").parquet(path)
