"""Applying a feed of inserts, updates and deletes by a commutative fold (problem 5).

A change becomes one row per attribute it sets, and one row for the life of its entity where it
creates or ends it.  Folding keeps per (entity, attribute) the maximum of (sequence, operation,
payload).  Maxima commute and repeat without harm, so late, unordered and doubled deliveries need
no order and no deduplication; a state folded earlier is further rows of the same kind.  Ended
entities stay in the state as tombstones, so that a late change finds that it is too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CREATES = ("create", "upsert")
STATE = "id string, attr string, seq bigint, alive boolean, val string"


def _object(c: str) -> Column:
    """The attributes of a complete JSON object, else null."""
    whole = F.try_parse_json(c).isNotNull() & F.ltrim(F.col(c)).startswith("{")
    return F.when(whole, F.from_json(c, "map<string,string>"))


def read_changes(log: DataFrame, seq: str = "change_seq") -> DataFrame:
    """(seq, op, key, e, r, changed_at) of each readable delivery; e and r are attribute maps.

    A delivery with an entity or relation that is no complete JSON object is unreadable, one
    without a sequence number or an operation too.  The key is the id, else the entity's own
    ``id``; an empty one is none.
    """
    parsed = log.where(F.col(seq).isNotNull() & F.col("op").isNotNull()).select(
        F.col(seq).alias("seq"), F.lower("op").alias("op"), "id", "changed_at",
        F.col("entity").isNull().alias("no_e"), F.col("relation").isNull().alias("no_r"),
        _object("entity").alias("e"), _object("relation").alias("r"),
    )
    return parsed.where((F.col("no_e") | F.col("e").isNotNull()) & (F.col("no_r") | F.col("r").isNotNull())).select(
        "seq", "op", F.coalesce(F.nullif("id", F.lit("")), F.nullif(F.col("e")["id"], F.lit(""))).alias("key"), "e", "r", "changed_at"
    )


def to_state(changes: DataFrame) -> DataFrame:
    """Unfolded state rows of readable changes; the row with a null attr is the entity's life."""
    own = changes.where(F.col("r").isNull() & F.col("key").isNotNull() & F.col("op").isin(*CREATES, "update", "delete"))
    creates = F.col("op").isin(*CREATES)
    life = F.when(F.col("op") != "update", F.array(F.struct(F.lit(None).cast("string").alias("attr"), creates.alias("alive"), F.lit(None).cast("string").alias("val"))))
    sets = F.when(
        F.col("op") != "delete",
        F.transform(F.map_entries("e"), lambda x: F.struct(x["key"].alias("attr"), F.lit(True).alias("alive"), x["value"].alias("val"))),
    )
    none = F.array().cast("array<struct<attr:string,alive:boolean,val:string>>")
    return own.select(
        F.col("key").alias("id"), "seq", F.explode(F.concat(F.coalesce(life, none), F.coalesce(sets, none))).alias("x")
    ).select("id", "x.attr", "seq", "x.alive", "x.val")


def fold(state: DataFrame, *more: DataFrame) -> DataFrame:
    """The latest row per (entity, attribute) of all states together, tombstones included."""
    for other in more:
        state = state.unionByName(other)
    return (
        state.groupBy("id", "attr")
        .agg(F.max(F.struct("seq", "alive", "val")).alias("x"))
        .select("id", "attr", "x.seq", "x.alive", "x.val")
    )


def alive_attributes(folded: DataFrame) -> DataFrame:
    """(id, attr, val): the attributes, other than ``id`` and null ones, of each entity alive.

    An attribute counts if it was set by the last creation of its entity or after it.
    """
    life = F.max(F.when(F.col("attr").isNull(), F.struct("seq", "alive"))).over(Window.partitionBy("id"))
    return (
        folded.withColumn("life", life)
        .where(F.col("life.alive") & (F.col("seq") >= F.col("life.seq")) & F.col("attr").isNotNull() & (F.col("attr") != "id") & F.col("val").isNotNull())
        .select("id", "attr", "val")
    )


def apply_changes(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(id, attr, val) of the entities alive after the last change of ``log``, on top of ``base``,
    a state folded earlier.

    Null and unreadable values as in ``read_changes``; empty texts are values; repeated rows
    change nothing; of different values set by one sequence number the largest holds; other
    columns are not read; an empty log gives the base's attributes, or no rows.
    """
    state = to_state(read_changes(log))
    return alive_attributes(fold(state, *([base] if base is not None else [])))
