"""All queries of the core, their SQL, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import problems, reference, reference_sql

QUERIES = {**reference.QUERIES, **problems.QUERIES}
SQL = {**reference_sql.SQL, **problems.SQL}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search for the ten best memories."""
    return reference.hybrid_dedup(spark, sf)
