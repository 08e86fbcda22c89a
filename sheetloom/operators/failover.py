"""Ordered attempts: which of them happened, and how they ended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank_models

# Attempts per credential, and per vendor.
MODEL_ATTEMPTS, VENDOR_ATTEMPTS = 5, 7
NO_CREDENTIALS = "no credentials"


def within_budget(log: DataFrame, chain: list[str], vendor: str = "vendor", credential: str = "credential", pos: str = "pos") -> DataFrame:
    """Attempts that the budgets allow: the first 5 on a credential, and of those the first 7 on a vendor."""
    by_credential = Window.partitionBy(*chain, vendor, credential).orderBy(pos)
    by_vendor = Window.partitionBy(*chain, vendor).orderBy(pos)
    some = log.withColumn("_n", F.row_number().over(by_credential)).where(F.col("_n") <= MODEL_ATTEMPTS)
    return some.withColumn("_n", F.row_number().over(by_vendor)).where(F.col("_n") <= VENDOR_ATTEMPTS).drop("_n")


def resolve(log: DataFrame, chain: list[str], pos: str = "pos", ok: str = "ok", retry: str = "retryable", error: str = "error", budget: int | None = None, keep: str = "last") -> DataFrame:
    """Per chain the outcome of attempts that stop at the first success or the first error that isn't retryable.

    Returns the chain's columns, outcome ('success', 'fatal' or 'exhausted'), stopped_at (position of the attempt that ended it,
    null if exhausted), attempts, and error: null after success, else the last error, or with keep='first' the first if all
    were retryable. Positions are counted from 1; those beyond ``budget`` never happen. One aggregation, combined before its shuffle.
    """
    some = log if budget is None else log.where(F.col(pos) <= budget)
    good = F.coalesce(F.col(ok), F.lit(False))
    fatal = ~good & ~F.coalesce(F.col(retry), F.lit(False))
    pick = F.min_by if keep == "first" else F.max_by
    told = some.groupBy(*chain).agg(
        F.min(F.when(good, F.col(pos))).alias("_ok"), F.min(F.when(fatal, F.col(pos))).alias("_fatal"), F.count(F.lit(1)).alias("_n"),
        F.min_by(error, F.when(fatal, F.col(pos))).alias("_fatal_error"), pick(error, F.when(~good, F.col(pos))).alias("_kept"),
    )
    stop = F.least("_ok", "_fatal")
    won = F.coalesce(F.col("_ok") == stop, F.lit(False))
    outcome = F.when(won, "success").when(F.col("_fatal").isNotNull(), "fatal").otherwise("exhausted")
    final = F.when(won, None).when(F.col("_fatal").isNotNull(), F.col("_fatal_error")).otherwise(F.col("_kept"))
    return told.select(*chain, outcome.alias("outcome"), stop.alias("stopped_at"), F.coalesce(stop, F.col("_n")).cast("long").alias("attempts"), final.alias("error"))


def gate_retries(log: DataFrame, chain: list[str], pos: str = "pos", emitted: str = "emitted", retry: str = "retryable") -> DataFrame:
    """T4: the log with ``retryable`` false from the first attempt on that has emitted anything: what was shown can't be taken back."""
    so_far = Window.partitionBy(*chain).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    shown = F.max(F.coalesce(F.col(emitted), F.lit(False))).over(so_far)
    return log.withColumn(retry, F.coalesce(F.col(retry), F.lit(False)) & ~shown)


def nested_chain(credentials: DataFrame, models: DataFrame, outcomes: DataFrame, chain: list[str]) -> DataFrame:
    """What happens when vendors, their credentials and each credential's models are tried in order, by the outcomes that each attempt would have.

    ``credentials``: the chain's columns, vendor, vendor_pos, credential, credential_pos and first (the model that is tried first); a vendor without any has one
    row with a null credential, which ends the chain. ``models``: the chain's columns, vendor, credential, model: what a credential's list names; it is asked for
    once, after the credential's first failure. ``outcomes``: the chain's columns, vendor, credential, model, ok, retryable, error; an
    attempt without one fails for good.

    A credential tries its first model and then the usable ones of its list from the best on, at most MODEL_ATTEMPTS; all credentials of a vendor share
    VENDOR_ATTEMPTS. The first success, or the first failure that can't be retried, ends the chain. Returns a row per
    attempt that happened, and for a vendor without credentials: attempt (from 1 in the chain), vendor, credential, model, ok, retryable, error, listed (this failure
    made the list be asked for), notice_to (the model that was announced instead, with the error as reason), and ended (nothing follows).
    Windows over one chain's attempts, of which there are few; ranking is within one credential.
    """
    own = [*chain, "vendor", "credential"]
    place = Window.partitionBy(*own).orderBy("rank")
    keys = credentials.select(*own, "vendor_pos", "credential_pos", "first")
    ranked = rank_models(models.select(*own, "model").distinct(), within=own).select(*[F.col(c).alias(f"_{c}") for c in own], "model", "rank")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
    others = keys.where("credential IS NOT NULL").join(ranked, same).where(F.col("model") != F.col("first"))
    others = others.select(*keys.columns, "model", (F.row_number().over(place) + 1).alias("model_pos"))
    tried = keys.select("*", F.when(F.col("credential").isNotNull(), F.col("first")).alias("model"), F.lit(1).alias("model_pos")).unionByName(others.where(F.col("model_pos") <= MODEL_ATTEMPTS + 1))
    after = Window.partitionBy(*own).orderBy("model_pos")
    tried = tried.withColumn("_next", F.lead("model").over(after)).where(F.col("model_pos") <= MODEL_ATTEMPTS)
    by_vendor = Window.partitionBy(*chain, "vendor_pos").orderBy("credential_pos", "model_pos")
    tried = tried.withColumn("_n", F.row_number().over(by_vendor)).where(F.col("_n") <= VENDOR_ATTEMPTS)
    told = outcomes.select(*[F.col(c).alias(f"_{c}") for c in (*own, "model")], "ok", "retryable", "error")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*own, "model")])
    tried = tried.join(told, same, "left").withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("retryable", ~F.col("ok") & F.coalesce("retryable", F.lit(False)))
    tried = tried.withColumn("error", F.when(F.col("credential").isNull(), F.lit(NO_CREDENTIALS)).when(~F.col("ok"), F.col("error")))
    order = Window.partitionBy(*chain).orderBy("vendor_pos", "credential_pos", "model_pos")
    ends = ~F.col("retryable")
    before = F.coalesce(F.max(ends).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    done = tried.withColumn("_over", before).where("NOT _over").withColumn("attempt", F.row_number().over(order))
    return done.select(
        *chain, "attempt", "vendor", "credential", "model", "ok", "retryable", "error", (F.col("retryable") & (F.col("model_pos") == 1)).alias("listed"),
        F.when(F.col("retryable"), F.col("_next")).alias("notice_to"), (ends | F.lead("attempt").over(order).isNull()).alias("ended"), "vendor_pos",
    )


def chain_outcome(attempts: DataFrame, chain: list[str]) -> DataFrame:
    """How each chain of :func:`nested_chain` ended: outcome ('success', 'fatal' or 'exhausted'), vendor, credential and model that succeeded, error, attempts and lists (how many were asked for).

    The error of a failure that can't be retried is told as it is; where all could be, that of the first vendor's last attempt: the vendor that was chosen.
    """
    tried = F.col("model").isNotNull()
    won = F.col("ok")
    told = attempts.groupBy(*chain).agg(
        F.max("ok").alias("_won"), F.max(~F.col("ok") & ~F.col("retryable")).alias("_fatal"), F.max(F.when(won, F.struct("vendor", "credential", "model"))).alias("w"),
        F.max_by("error", F.when(~F.col("ok") & ~F.col("retryable"), F.col("attempt"))).alias("_last"), F.max_by("error", F.struct(-F.col("vendor_pos"), "attempt")).alias("_first"),
        F.count_if(tried).alias("attempts"), F.count_if(F.col("listed")).alias("lists"), F.count("notice_to").alias("notices"),
    )
    outcome = F.when(F.col("_won"), "success").when(F.col("_fatal"), "fatal").otherwise("exhausted")
    error = F.when(F.col("_won"), None).when(F.col("_fatal"), F.col("_last")).otherwise(F.col("_first"))
    return told.select(*chain, outcome.alias("outcome"), F.col("w.vendor").alias("vendor"), F.col("w.credential").alias("credential"), F.col("w.model").alias("model"), error.alias("error"), "attempts", "lists", "notices")
