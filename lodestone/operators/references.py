"""References to records that do not exist (problem 2).

The keys ever created go into a Bloom filter of bounded size, which is broadcast.  A reference
the filter refuses is an orphan for certain.  The others are verified by an exact join: whether
the key was alive just before the reference.  That is a search for the latest earlier life event
of the key; keys with very many events are cut along the sequence, and each stretch begins with
the state the stretches before it left, so that no key is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.changes import CREATES, read_changes
from lodestone.session import cut

#: Bits of the filter: about ten per key, within these bounds (32 MB at most).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28
HASHES = 5
#: Sequence numbers of one stretch of a key's events.
STRETCH = 1 << 16
_BUCKET = 32_768  # bits of a bitmap of Spark's bitmap functions


class BloomFilter:
    """Bits chosen by two 64-bit hashes per key; false positives only."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.size = len(bits) * 8

    @staticmethod
    def hashes(column: str):
        return F.xxhash64(column), F.xxhash64(F.lit(31), column)

    @classmethod
    def build(cls, keys: DataFrame, column: str) -> BloomFilter:
        n = keys.agg(F.approx_count_distinct(column, 0.02)).first()[0]
        size = LEAST_BITS
        while size < min(10 * n, MOST_BITS):
            size *= 2
        a, b = cls.hashes(column)
        places = keys.select(a.alias("a"), b.alias("b")).select(
            F.explode(F.array(*(F.col("a").bitwiseXOR(F.shiftleft("b", 7 * i)).bitwiseAND(F.lit(size - 1)) for i in range(HASHES)))).alias("p")
        )
        at = F.col("p")
        maps = (
            places.select((at / _BUCKET).cast("int").alias("k"), (at % _BUCKET).alias("bit"))
            .groupBy("k")
            .agg(F.expr("bitmap_construct_agg(bit)").alias("m"))
        )
        bits = np.zeros(size // 8, np.uint8)
        for row in maps.collect():  # size / 32,768 rows of 4 kB
            bits[row.k * _BUCKET // 8 : (row.k + 1) * _BUCKET // 8] = np.frombuffer(row.m, np.uint8)
        return cls(bits)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(HASHES):
            p = (a ^ (b << np.int64(7 * i))) & np.int64(self.size - 1)
            out &= (self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out

    def predicate(self, spark):
        """A function of the two hash columns."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def maybe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for a, b in batches:
                yield pd.Series(shared.value.holds(a.to_numpy(), b.to_numpy()))

        return maybe


def references(changes: DataFrame) -> DataFrame:
    """(seq, op, changed_at, field, ref): the references of each readable change, null and empty
    ones left out.  Repeated deliveries give repeated rows."""
    has = F.map_contains_key
    end = lambda first, second: F.when(has("r", first), F.col("r")[first]).otherwise(F.col("r")[second])
    ref = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("ref"))
    none = F.lit(None).cast("string")
    refs = F.array(
        ref("from", end("from", "source")),
        ref("to", end("to", "target")),
        ref("owner", F.col("e")["owner"]),
        ref("id", F.when(F.col("op").isin("update", "delete") & F.col("r").isNull(), F.col("key")).otherwise(none)),
    )
    return changes.select("seq", "op", "changed_at", F.explode(refs).alias("x")).select("seq", "op", "changed_at", "x.*").where("ref <> ''")


def _before(life: DataFrame, refs: DataFrame, stretch: int) -> DataFrame:
    """refs (key, seq, ...) with ``alive``, the last life event of the key before seq, or null;
    ``created``, whether it was created by then, seq included; and ``ever``, whether it ever was.

    What a key's earlier stretches leave, and whether it is ever created, comes from one row per key
    and stretch, so no row of a key with very many of them waits for a join by that key.
    """
    part = F.floor(F.col("seq") / stretch)
    life = life.withColumn("part", part).withColumn("made", F.col("alive"))
    refs = refs.withColumn("part", part)
    none = F.lit(None).cast("boolean")
    left = life.groupBy("key", "part").agg(F.max_by("alive", "seq").alias("left"), F.max("alive").alias("made"))
    asked = refs.select("key", "part").distinct().withColumns({"left": none, "made": none})
    stretches = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        left.union(asked)
        .groupBy("key", "part")
        .agg(F.max("left").alias("left"), F.max("made").alias("made"))  # one value at most is not null
        .withColumns({
            "alive": F.last("left", True).over(stretches), "earlier": F.max("made").over(stretches), "ever": F.max("made").over(Window.partitionBy("key")),
        })
        .where("alive is not null or ever")
        .select("key", "part", (F.col("part") * stretch - 1).alias("seq"), "alive", F.col("earlier").alias("made"), "ever")
    )
    events = refs.withColumns({"alive": none, "made": none, "ever": none, "rank": F.lit(0)})
    events = events.unionByName(carried.withColumn("rank", F.lit(1)), True).unionByName(life.withColumn("rank", F.lit(1)), True)
    of = Window.partitionBy("key", "part")
    before = of.orderBy("seq", "rank").rowsBetween(Window.unboundedPreceding, -1)
    # sorted once: rows of one seq come behind the row asked for, so they are looked for behind it too
    by_then = of.orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumns({"alive": F.last("alive", True).over(before), "ever": F.max("ever").over(before), "created": F.max("made").over(by_then)})
        .where("rank = 0").drop("rank", "part", "made")
    )


def orphans(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(change_seq, ref_field, ref_id, reason, op, changed_at): references to entities that are
    not alive just before the change.

    reason is ``missing`` (never created), ``late`` (first created by a later change) or
    ``deleted``.  Unreadable deliveries, nulls and repeated rows as in ``changes.read_changes``:
    each reference counts once, with the smallest op and changed_at of its deliveries.  Other
    columns are not read; an empty log gives no rows.
    """
    spark = log.sparkSession
    changes = read_changes(log)
    compact = cut(
        changes.select(
            "seq", "op", "key", "changed_at", F.map_filter("e", lambda k, _: k == "owner").alias("e"),
            F.map_filter("r", lambda k, _: k.isin("from", "source", "to", "target")).alias("r"),
        )
    )
    life = compact.where(F.col("r").isNull() & F.col("key").isNotNull() & F.col("op").isin(*CREATES, "delete")).select(
        "key", "seq", F.col("op").isin(*CREATES).alias("alive")
    )
    refs = references(compact).groupBy("seq", "field", "ref").agg(F.min("op").alias("op"), F.min("changed_at").alias("changed_at"))
    created = life.where("alive").select("key")
    bloom = BloomFilter.build(created, "key")
    probed = cut(refs.withColumnRenamed("ref", "key").withColumn("maybe", bloom.predicate(spark)(*BloomFilter.hashes("key"))))
    certain = probed.where("not maybe").withColumn("reason", F.lit("missing"))
    verified = (
        _before(life, probed.where("maybe"), stretch)
        .where("alive is null or not alive")
        .withColumn("reason", F.when(F.col("created"), "deleted").when(F.col("ever"), "late").otherwise("missing"))
    )
    columns = [F.col("seq").alias("change_seq"), F.col("field").alias("ref_field"), F.col("key").alias("ref_id"), "reason", "op", "changed_at"]
    return certain.select(columns).unionByName(verified.select(columns))


def orphan_counts(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(op, month, reason, n): orphans per op and month (yyyy-MM) of changed_at, null where it is null."""
    return (
        orphans(log, stretch)
        .groupBy("op", F.date_format("changed_at", "yyyy-MM").alias("month"), "reason")
        .agg(F.count("*").alias("n"))
    )
