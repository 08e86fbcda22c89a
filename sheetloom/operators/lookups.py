"""Lookups with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dictionary(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A value of a small constant dictionary, the default (or null) for what isn't in it."""
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def lookup(rows: DataFrame, table: DataFrame, key: str, table_key: str, value: str, default: object = None, name: str | None = None) -> DataFrame:
    """Rows with the table's value for their key, the default where there is none. Spark broadcasts the table if it is small; of repeated keys the least value is taken."""
    one = table.groupBy(F.col(table_key).alias("_key")).agg(F.min(value).alias("_value"))
    found = F.coalesce("_value", F.lit(default)) if default is not None else F.col("_value")
    return rows.join(one, F.col(key) == F.col("_key"), "left").withColumn(name or value, found).drop("_key", "_value")
