"""From files to rows of the memory store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunks
from lodestone.sources import notes as ns
from lodestone.sources.guards import inside

MEMORY_COLUMNS = ("id", "content", "category", "layer", "source", "score", "created_at", "updated_at", "superseded_by")
LABELS = ("category", "layer", "source", "score")
GENERAL, EPISODIC, DIRECTORY_SCORE = "general", "episodic", 0.5


def memory_rows(contents: DataFrame, at: Column, cap: bool = True) -> DataFrame:
    """Memories of (content, category, layer, source, score): one per chunk.

    The id is a hash of source and place, so indexing again gives the same ids and needs no
    global numbering; blank chunks and null contents give no row.
    """
    cut = chunks.chunk_rows(contents.withColumn("k", F.struct(*LABELS)), "k", "content", cap)
    return _placed(cut.select("k.*", "chunk_no", F.col("chunk").alias("content")), "chunk_no", at)


def log_rows(contents: DataFrame, at: Column) -> DataFrame:
    """Memories of (content, category, layer, source, score), content being a log of JSON lines:
    ``name (type)`` of each line that holds an object, neither chunked nor capped.

    Blank and broken lines and null contents give no row; equal lines give one each, and the id is
    a hash of source and line.
    """
    lines = contents.select(*LABELS, F.posexplode(F.split("content", "\r\n|\r|\n")).alias("line_no", "value"))
    objects = lines.where(fx.strip(F.col("value")).startswith("{"))
    return _placed(ns.jsonl_contents(objects, "value", (*LABELS, "line_no")), "line_no", at)


def _placed(rows: DataFrame, place: str, at: Column) -> DataFrame:
    return rows.select(
        F.xxhash64("source", place).alias("id"), "content", *LABELS,
        at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("bigint").alias("superseded_by"),
    )


def index_workspace(files: DataFrame, at: Column) -> DataFrame:
    """Memories of the files (file_path relative to the workspace, content) that have a class: of
    texts by chunk, of the ontology log by line."""
    known = ns.classify_files(files).select("content", *LABELS)
    log = F.col("source") == ns.LOG_FILE
    return memory_rows(known.where(~log), at).unionByName(log_rows(known.where(log), at))


def index_directory(files: DataFrame, at: Column, category: str = GENERAL, layer: str = EPISODIC, score: float = DIRECTORY_SCORE) -> DataFrame:
    """Memories of any files (file_name, content), all of one category, layer and score."""
    rows = files.select("content", F.lit(category).alias("category"), F.lit(layer).alias("layer"), F.col("file_name").alias("source"), F.lit(score).alias("score"))
    return memory_rows(rows, at)


def add_file(spark: SparkSession, path: str, workspace: str, at: Column, category: str = GENERAL, layer: str = EPISODIC) -> DataFrame:
    """Memories of one file of the workspace, to append to the store; a path outside is refused."""
    files = ns.read_files(spark, inside(workspace, path), glob="*")
    return index_directory(files, at, category, layer)


class Busy(Exception):
    """Raised by a client that asks to be called again later."""


def _called(call: Callable, retries: int, wait: float, busy: float):
    """call, repeated ``retries`` times with pauses, longer ones where the client is busy; then None."""

    def one(x):
        for n in range(retries):
            try:
                return call(x)
            except Busy:
                pause = busy
            except Exception:  # noqa: BLE001
                pause = wait
            if n < retries - 1:
                time.sleep(pause)
        return None

    return one


def embed(memories: DataFrame, make_client: Callable[[], Callable[[str], list[float]]], retries: int = 3, most: int = chunks.CHUNK, wait: float = 1, busy: float = 5) -> DataFrame:
    """(id, embedding) from a client made once per task; it gets ``most`` characters of a content.

    A call that fails is repeated after ``wait`` seconds, after ``busy`` where it raised Busy; after
    ``retries`` failures the embedding is null, so that one text doesn't end the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _called(make_client(), retries, wait, busy)
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": [one(t) for t in batch["t"]]})

    source = memories.where("content is not null").select("id", F.substring("content", 1, most).alias("t"))
    return source.mapInPandas(run, "id bigint, embedding array<float>")


def summarise(texts: DataFrame, make_client: Callable[[], Callable[[list[str]], str]], retries: int = 1, wait: float = 1, busy: float = 5) -> DataFrame:
    """(key, summary) of the clusters' (key, texts) from a client; null where it fails, so that the
    sample's beginning stands in (consolidate.summary_of)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _called(make_client(), retries, wait, busy)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "summary": [one(list(t)) for t in batch["texts"]]})

    return texts.select("key", "texts").mapInPandas(run, "key string, summary string")
