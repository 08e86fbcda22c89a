"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Everything here is a column expression; no Python runs on the executors. Rows get dense numbers
0..N-1, a keyed permutation of 0..N-1 maps each number to a position, and position ``p`` is slot
``p div shards`` of shard ``p mod shards``. Both directions are computable from N and the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

ROUNDS = 6
#: First walk steps that every row out of range may take; the few rows that need more walk on, as far as the domain's excess.
NEAR_WALK = 32
#: Buckets that are numbered apart, at least.
LEAST_BUCKETS = 64
#: Numbers of a repeated key that are spread out at a time.
RUN = 10_000


def _sides(n: Column) -> tuple[Column, Column]:
    """The domain: ``left * right`` >= n with an excess under ``left``, which is about sqrt(n)."""
    left = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    return left, F.greatest(F.ceil(n / left), F.lit(1)).cast("long")


def _mix(half: Column, turn: Column, seed: int, size: Column) -> Column:
    return F.pmod(F.xxhash64(half, turn, F.lit(seed).cast("long")), size)


def _network(x: Column, n: Column, seed: int, inverse: bool) -> Column:
    left, right = _sides(n)
    split = F.struct(F.pmod(x, left).alias("l"), F.floor(x / left).cast("long").alias("r"))
    # x / left is a double: exact while x < 2**53, far beyond any row count.
    if inverse:

        def turn(s: Column, i: Column) -> Column:
            r = F.pmod(s["r"] - _mix(s["l"], i * 2 + 1, seed, right), right)
            return F.struct(F.pmod(s["l"] - _mix(r, i * 2, seed, left), left).alias("l"), r.alias("r"))

        turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0))
    else:

        def turn(s: Column, i: Column) -> Column:
            low = F.pmod(s["l"] + _mix(s["r"], i * 2, seed, left), left)
            return F.struct(low.alias("l"), F.pmod(s["r"] + _mix(low, i * 2 + 1, seed, right), right).alias("r"))

        turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, split, turn, lambda s: s["r"] * left + s["l"])


def _walk(x: Column, n: Column, seed: int, inverse: bool) -> Column:
    """Apply the network until the value is below n. A walk can leave the range for at most ``left - 1`` steps, the number of values out of range, so the last step is exact for every n."""
    left, _ = _sides(n)
    on = lambda acc, _: F.when(acc < n, acc).otherwise(_network(acc, n, seed, inverse))
    first = _network(x, n, seed, inverse)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(NEAR_WALK)), first, on)
    return F.when(first < n, first).when(near < n, near).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), left), near, on))


def permute(x: Column, n: Column, seed: int = 0) -> Column:
    """Position of row number ``x`` (long, 0 <= x < n) in the keyed shuffle of 0..n-1; null for null."""
    return _walk(x, n, seed, False)


def unpermute(position: Column, n: Column, seed: int = 0) -> Column:
    """The row number at ``position``: the inverse of :func:`permute`."""
    return _walk(position, n, seed, True)


def number_rows(df: DataFrame, key: list[str], rows_per_bucket: int = 50_000, number: str = "row_number", total: str = "n_rows") -> DataFrame:
    """The key columns of every row of ``df`` with dense row numbers 0..N-1 that depend on the keys alone, not on how rows are partitioned.

    Rows equal in every key column are interchangeable: they are counted first, numbered as one with the numbers they need, and
    spread out again in runs of RUN numbers, so a key that many rows repeat is no burden to any task. Distinct keys are ordered by hash bucket
    and then by key; the number of buckets follows from N. Buckets' sums give each its offset; whether the
    offsets (16 bytes for ``rows_per_bucket`` rows) are broadcast is left to Spark, which knows their
    written size. Nulls are keys like others. No rows: no rows.
    """
    distinct = materialize(df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), "keys")
    rows, keys = distinct.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(LEAST_BUCKETS, -(-keys // rows_per_bucket))
    dealt = distinct.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets).cast("long")))
    sums = dealt.groupBy("_bucket").agg(F.sum("_n").alias("_sum"))
    before = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sums.select("_bucket", F.coalesce(F.sum("_sum").over(before("_bucket")), F.lit(0)).alias("_offset")), "offsets")
    within = Window.partitionBy("_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    begun = dealt.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, "_bucket").withColumn("_at", F.col("_at") + F.col("_offset"))
    last = F.col("_at") + F.col("_n")
    single = begun.where("_n = 1").select(*key, F.col("_at").alias(number))
    runs = begun.where("_n > 1").select(*key, last.alias("_last"), F.explode(F.sequence("_at", last - 1, F.lit(RUN).cast("long"))).alias("_from"))
    if not distinct.where(F.col("_n") > RUN).isEmpty():
        runs = runs.repartition(*key, "_from")
    several = runs.select(*key, F.explode(F.sequence("_from", F.least(F.col("_from") + RUN, "_last") - 1)).alias(number))
    return single.unionByName(several).withColumn(total, F.lit(rows).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20240229, rows_per_bucket: int = 50_000) -> DataFrame:
    """Every row of ``docs`` (columns doc_id and text are used, others ignored) in one of ``shards`` shards.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, row_number, n_rows, shard, slot. Law:
    the shards' row counts are at most one apart, and slots are gapless from 0 in each shard. A null text
    counts as empty; null and repeated doc_ids each keep their own slot; an empty table gives no rows. Only
    doc_id, size and checksum are shuffled, never texts. Equal texts are not kept together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lean = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(lean, ["doc_id", "text_crc32", "size"], rows_per_bucket)
    position = permute(F.col("row_number"), F.col("n_rows"), seed)
    placed = numbered.withColumn("_position", position)
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", "n_rows",
        F.pmod(F.col("_position"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_position") / shards).cast("long").alias("slot"),
    )


def row_at(shard: Column, slot: Column, n: Column, shards: int = 16, seed: int = 20240229) -> Column:
    """The row number stored at a shard's slot, without any lookup."""
    return unpermute(slot * shards + shard, n, seed)
