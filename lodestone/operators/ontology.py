"""Health of the ontology log as it was written, line by line.

Here the order is that of the lines (line_no), deletes end nothing and a reference counts against
creations on earlier lines; ``changes`` and ``references`` work by change_seq instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import changes as ch


def _lines(log: DataFrame) -> DataFrame:
    return ch.read_changes(log, "line_no")


def replay(log: DataFrame) -> DataFrame:
    """(id, attr, val): attributes of each entity after the last line.  A create or upsert
    replaces the entity, an update merges into one that exists."""
    kept = _lines(log).where(F.col("op").isin(*ch.CREATES, "update"))
    return ch.alive_attributes(ch.fold(ch.to_state(kept)))


def entities(log: DataFrame) -> DataFrame:
    """(id, type): each entity ever created, with its type after the last line or ``unknown``."""
    folded = ch.fold(ch.to_state(_lines(log).where(F.col("op").isin(*ch.CREATES, "update"))))
    created = F.max(F.when(F.col("attr").isNull(), F.col("seq")))
    kind = F.max(F.when(F.col("attr") == "type", F.struct("seq", "val")))
    return (
        folded.where("attr is null or attr = 'type'")
        .groupBy("id")
        .agg(created.alias("created"), kind.alias("t"))
        .where("created is not null")
        .select("id", F.when(F.col("t.seq") >= F.col("created"), F.coalesce("t.val", F.lit("unknown"))).otherwise("unknown").alias("type"))
    )


def type_counts(log: DataFrame, n: int = 10) -> DataFrame:
    return entities(log).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(n)


def _endpoints(log: DataFrame) -> DataFrame:
    """(line, side, ref) of each relation; the second key counts only where the first is absent."""
    has = F.map_contains_key
    lines = _lines(log).where(F.col("r").isNotNull() & F.col("op").isin("relate", *ch.CREATES))
    side = lambda name, a, b: F.struct(F.lit(name).alias("side"), F.when(has("r", a), F.col("r")[a]).otherwise(F.col("r")[b]).alias("ref"))
    return lines.select(F.col("seq").alias("line"), F.explode(F.array(side("from", "from", "source"), side("to", "to", "target"))).alias("x")).select(
        "line", "x.side", "x.ref"
    )


def early_references(log: DataFrame) -> DataFrame:
    """(line_no, side, ref): endpoints of relations that no earlier line creates."""
    first = (
        _lines(log).where(F.col("r").isNull() & F.col("key").isNotNull() & F.col("op").isin(*ch.CREATES))
        .groupBy(F.col("key").alias("ref")).agg(F.min("seq").alias("first"))
    )
    ends = _endpoints(log).where("ref <> ''")
    return ends.join(first, "ref", "left").where("first is null or first >= line").select(F.col("line").alias("line_no"), "side", "ref")


def totals(log: DataFrame) -> DataFrame:
    """One row: entities, relations, orphan endpoints, creating lines (repeats counted)."""
    lines = _lines(log)
    creating = F.col("op").isin(*ch.CREATES)
    counts = lines.agg(
        F.count_distinct(F.when(creating & F.col("r").isNull(), F.col("key"))).alias("total_entities"),
        F.count_if(F.col("r").isNotNull() & (creating | (F.col("op") == "relate"))).alias("total_relations"),
        F.count_if(creating).alias("create_lines"),
    )
    orphan = early_references(log).agg(F.count("*").alias("orphan_relations"))
    return counts.withColumn("one", F.lit(1)).join(orphan.withColumn("one", F.lit(1)), "one").drop("one")


def sound_lines(log: DataFrame) -> DataFrame:
    """line_no of the lines that can be read."""
    return _lines(log).select(F.col("seq").alias("line_no"))


def dedup_lines(log: DataFrame) -> DataFrame:
    """line_no of the lines a repair keeps: sound ones, and of those naming an entity the first per
    entity, whatever its op (later updates of it are lost: the repair is lossy)."""
    lines = _lines(log).select("seq", F.nullif(F.col("e")["id"], F.lit("")).alias("eid"))
    first = lines.where("eid is not null").groupBy("eid").agg(F.min("seq").alias("line_no")).select("line_no")
    return first.unionByName(lines.where("eid is null").select(F.col("seq").alias("line_no")))
