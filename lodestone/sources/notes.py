"""Notes: from a folder of Markdown files, from tables, and the classes of a workspace's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx

MEMORY_FILE, LOG_FILE = "MEMORY.md", "ontology/graph.jsonl"


def read_files(spark: SparkSession, path: str, glob: str = "*.md", recursive: bool = False, secrets: bool = False) -> DataFrame:
    """(file_path, file_name, mtime, content): one row per text file; unreadable bytes are replaced.

    Files whose path names a secret are not read, but with ``secrets``."""
    reader = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    files = reader.load(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("value").alias("content"),
    )
    return files if secrets else without_secrets(files)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Health runs, one JSON file per day, in the columns of the table; broken files give nulls."""
    schema = (
        "date string, mode string, memory struct<size_bytes: bigint>, daily_notes struct<total_notes: bigint>, benchmark string,"
        "ontology struct<total_entities: bigint, total_relations: bigint, orphan_relations: bigint>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select(
        F.col("date").alias("run_date"), F.col("mode").alias("run_mode"), F.col("memory.size_bytes").alias("size_bytes"), "ontology.*",
        F.col("daily_notes.total_notes").alias("note_count"), F.col("benchmark").alias("benchmark_score"),
    )


def without_secrets(files: DataFrame, column: str = "file_path") -> DataFrame:
    """Files whose whole path names no secret; a null path names none."""
    return files.where(~F.coalesce(F.col(column).rlike(fx.SECRET_PATHS), F.lit(False)))


def latest_files(notes: DataFrame) -> DataFrame:
    """One row per file name: the delivery with the greatest (mtime, content)."""
    return (
        notes.where(F.col("file_name").isNotNull())
        .groupBy("file_name")
        .agg(F.max(F.struct("mtime", "content")).alias("x"))
        .select("file_name", "x.mtime", "x.content")
    )


def dated(notes: DataFrame) -> DataFrame:
    """(source, day, chunk, content) of files named after a valid date."""
    day = fx.note_date(F.col("file_name"))
    return latest_files(notes).withColumn("day", day).where("day is not null").select(
        F.col("file_name").alias("source"), "day", F.lit(0).cast("bigint").alias("chunk"), "content"
    )


def long_term(memories: DataFrame, as_of: Column) -> DataFrame:
    """(source, day, chunk, content) of the chunks of MEMORY.md, which are always of today.

    An id delivered twice counts once."""
    return (
        memories.where(F.col("source") == MEMORY_FILE)
        .groupBy("id")
        .agg(F.max("content").alias("content"))
        .select(F.lit(MEMORY_FILE).alias("source"), as_of.alias("day"), F.col("id").alias("chunk"), "content")
    )


def classify_files(files: DataFrame) -> DataFrame:
    """(file_name, category, layer, source, score) by a file's place in the workspace.

    ``file_path`` is relative to the workspace; files of no class are left out, other columns (``content``, say) stay.
    """
    p, name = F.col("file_path"), F.element_at(F.split("file_path", "/"), -1)
    rule = lambda category, layer, source, score: F.struct(
        category.alias("category"), F.lit(layer).alias("layer"), source.alias("source"), F.lit(score).alias("score")
    )
    klass = (
        F.when(p.rlike(r"\Amemory/\d{4}-[^/]*\.md\z"), rule(F.lit("daily-note"), "episodic", name, 0.3))
        .when(p.rlike(r"\A(?:memory/)?archive/[^/]+\.md\z"), rule(F.lit("archive"), "episodic", F.concat(F.lit("archive/"), name), 0.1))
        .when(p.rlike(r"\Askills/[^/]+/SKILL\.md\z"), rule(F.lit("skill"), "procedural", p, 0.8))
        .when(p.rlike(r"\Amemory/[^/]+\.md\z"), rule(fx.category_of_file(name), "semantic", name, 0.7))
        .when(p == "MEMORY.md", rule(F.lit("long-term-memory"), "procedural", name, 0.9))
        .when(p == "TOOLS.md", rule(F.lit("config"), "procedural", name, 0.7))
        .when(p.rlike(r"\A(?:memory/)?ontology/graph\.jsonl\z"), rule(F.lit("ontology"), "semantic", F.lit(LOG_FILE), 0.6))
    )
    kept = [c for c in files.columns if c not in ("file_name", "category", "layer", "source", "score")]
    return files.withColumn("k", klass).where("k is not null").select(*kept, name.alias("file_name"), "k.*")


def jsonl_contents(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``name (type)`` of each line of JSON, missing ones empty; broken and blank lines are left out.
    The columns of ``keep`` stay beside it."""
    v = F.try_parse_json(F.col(column))
    return lines.where(fx.strip(F.col(column)) != "").select(*keep, v.alias("v")).where("v is not null").select(
        *keep, F.format_string(
            "%s (%s)",
            F.coalesce(F.try_variant_get("v", "$.name", "string"), F.lit("")),
            F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("")),
        ).alias("content")
    )
