"""What of a history is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES = 25  # fixed value


def newest(entries: DataFrame, at: str, tie: list[str], n: int = MOST_ENTRIES, within: list[str] | None = None) -> DataFrame:
    """The newest n entries, per key if given; else a top-n without a full sort. Ties go by the ``tie`` columns, ascending."""
    order = [F.col(at).desc_nulls_last(), *tie]
    if not within:
        return entries.orderBy(*order).limit(n)
    rows = entries.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    return rows.where(F.col("_n") <= n).drop("_n")


def byte_budget(entries: DataFrame, within: list[str], at: str, tie: list[str], base: str, extra: str, budget: int, slices: Column | None = None) -> DataFrame:
    """Entries with keep_entry and keep_extra, as if the oldest extras and then the oldest entries were shed until all fits.

    ``base`` and ``extra`` are sizes in bytes (null: 0). A history is one window partition. Where one may hold a large share
    of all entries, ``slices``, an expression that never falls as ``at`` rises, cuts it: the slices' sums, combined
    before their shuffle, give each slice what is newer than it, and windows stay within a slice. ``at`` is not null then.
    """
    rows = entries.withColumn("_b", F.coalesce(base, F.lit(0)).cast("long")).withColumn("_x", F.coalesce(extra, F.lit(0)).cast("long"))
    key = list(within)
    if slices is None:
        rows = rows.withColumn("_all", F.sum("_b").over(Window.partitionBy(*key))).withColumn("_newer_b", F.lit(0)).withColumn("_newer_x", F.lit(0))
    else:
        rows = rows.withColumn("_slice", slices)
        newer = Window.partitionBy(*key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*key, "_slice").agg(F.sum("_b").alias("_sb"), F.sum("_x").alias("_sx"))
        before = lambda c: F.coalesce(F.sum(c).over(newer), F.lit(0))
        sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("_slice").alias("_k"), F.sum("_sb").over(Window.partitionBy(*key)).alias("_all"), before("_sb").alias("_newer_b"), before("_sx").alias("_newer_x"))
        same = F.col("_slice").eqNullSafe(F.col("_k"))
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        rows = rows.join(sums, same)
        key.append("_slice")
    from_newest = Window.partitionBy(*key).orderBy(F.col(at).desc_nulls_last(), *tie).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.col("_all") <= budget
    rows = rows.withColumn("_cb", F.col("_newer_b") + F.sum("_b").over(from_newest)).withColumn("_cx", F.col("_newer_x") + F.sum("_x").over(from_newest))
    kept = fits & (F.col("_all") + F.col("_cx") <= budget) & (F.col("_x") > 0)
    return rows.select(*entries.columns, (fits | (F.col("_cb") <= budget)).alias("keep_entry"), kept.alias("keep_extra"))


def replace_value(entries: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Entries with the value that ``changes`` holds for their key; keys that aren't there change nothing."""
    new = changes.select(F.col(key).alias("_key"), F.col(value).alias("_new"), F.lit(True).alias("_has"))
    joined = entries.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value))).select(*entries.columns)


def without_ids(entries: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """K4: entries but for those with the ids; entries with a null id stay."""
    return entries.where(~F.coalesce(F.col(key).isin(ids), F.lit(False)))


def prepend(new: DataFrame, old: DataFrame, position: str = "pos") -> DataFrame:
    """Both tables' rows, the new ones before the old: negative positions for new rows are shifted below the old ones' least."""
    first = new.withColumn("_block", F.lit(0)).unionByName(old.withColumn("_block", F.lit(1)))
    return first.withColumn(position, F.struct("_block", position)).drop("_block")
