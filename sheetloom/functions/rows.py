"""Columns that are computed once a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def also(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed once a row: later expressions, and functions over arrays in them, read them instead of holding them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
