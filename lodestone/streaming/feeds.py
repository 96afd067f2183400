"""Structured Streaming forms of the batch operators.

Line items are stateless per file.  The change feed keeps its folded state in runs of files: a
micro-batch writes the fold of its own changes only, and every FAN runs of a level are folded into
one of the next.  So a row is written again once per level and not once per batch, and a state is
read from few runs.  Since folding commutes and repeats without harm, a batch that is delivered
again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import changes as ch
from lodestone.operators.items import extract_items
from lodestone.sources import notes as ns

#: Runs of a level that are folded into one of the next.
FAN = 8
LOG = "line_no bigint, change_seq bigint, op string, id string, entity string, relation string, changed_at timestamp, logged_at timestamp, writer string"


def stream_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of the notes that arrive in a folder, of those whose path names no secret; no shuffle
    and no state."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
    files = ns.without_secrets(files.select("value", "_metadata"), "_metadata.file_path")
    named = files.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("content"))
    day = ns.fx.note_date(F.col("source"))
    return extract_items(named.select("source", day.alias("day"), F.lit(0).cast("bigint").alias("chunk"), "content").where("day is not null"))


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/level={level}/run={number:012d}"


def runs_of(version: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, number) of the runs that make up the state after ``version`` batches: the digits of
    that number to the base ``fan``."""
    out, level, below = [], 0, version
    while below:
        below, digit = divmod(below, fan)
        out += [(level, below * fan + k) for k in range(digit)]
        level += 1
    return out


def read_state(spark: SparkSession, path: str, version: int, fan: int = FAN) -> DataFrame:
    """The folded state after ``version`` batches."""
    paths = [_run(path, *r) for r in runs_of(version, fan)]
    return ch.fold(spark.read.schema(ch.STATE).parquet(*paths)) if paths else spark.createDataFrame([], ch.STATE)


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def apply_stream(spark: SparkSession, feed: str, state: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Folds the Parquet files that arrive in ``feed`` into runs of the state below ``state``.

    The state after batch n is version n + 1; ``read_state`` with ``changes.alive_attributes``
    gives the attributes of the entities alive.  Runs that were folded into another one go when the
    next batch comes, for until then the batch that folded them may come again.
    """

    def fold_batch(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        folded = [(level, number // fan) for level, number in _ends(n)]
        for level, number in folded:  # of the batch before this one, which is done
            for k in range(fan):
                _drop(session, _run(state, level, number * fan + k))
        ch.fold(ch.to_state(ch.read_changes(batch))).write.mode("overwrite").parquet(_run(state, 0, n))
        for level, number in _ends(n + 1):
            below = [_run(state, level, number // fan * fan + k) for k in range(fan)]
            ch.fold(session.read.schema(ch.STATE).parquet(*below)).write.mode("overwrite").parquet(_run(state, level + 1, number // fan))

    def _ends(version: int) -> list[tuple[int, int]]:
        """(level, number) of the last run of each level that batch version - 1 filled up."""
        out, level = [], 0
        while version and version % fan == 0:
            out.append((level, version - 1))
            version, level = version // fan, level + 1
        return out

    rows = spark.readStream.schema(LOG).parquet(feed)
    return rows.writeStream.foreachBatch(fold_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
