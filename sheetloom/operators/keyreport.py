"""What is in pools of keys, without showing the keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import fingerprint


def fingerprints(keys: DataFrame, key: str, pool: list[str]) -> DataFrame:
    """A1: per pool and fingerprint: n and duplicate (n > 1). One aggregation, combined before its shuffle."""
    return keys.groupBy(*pool, fingerprint(F.col(key)).alias("fp")).agg(F.count(F.lit(1)).alias("n")).withColumn("duplicate", F.col("n") > 1)


def pool_report(keys: DataFrame, key: str, pool: list[str]) -> DataFrame:
    """A1: per pool: count, distinct and duplicates (how many fingerprints occur more than once)."""
    counted = fingerprints(keys, key, pool)
    return counted.groupBy(*pool).agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("distinct"), F.count_if("duplicate").alias("duplicates"))


def flagged(keys: DataFrame, key: str, pool: list[str]) -> DataFrame:
    """A1: every key's row as fp, prefix, length and duplicate; a null key or pool is a value like others."""
    rows = keys.select(*pool, fingerprint(F.col(key)).alias("fp"), F.substring(key, 1, 4).alias("prefix"), F.length(key).alias("length"))
    counted = fingerprints(keys, key, pool).select(*[F.col(c).alias(f"_{c}") for c in (*pool, "fp")], "duplicate")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*pool, "fp")])
    return rows.join(counted, same).select(*rows.columns, "duplicate")
