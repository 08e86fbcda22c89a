"""Scores, ranks and custom orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a model's name says about its use, in the rules' order.
UNFIT = "embedding|imagen|veo|tts|whisper|guard|moderation|aqa|rerank"
MAKES_IMAGES = "-image($|-)|image-gen|nano-banana"
DATED = r"\d{3,4}-\d{2}-\d{2}|\d{6,8}"
VERSION = r"(?:^|[-/a-z])(\d{1,2})(?:\.(\d+))?(?![\d.a-z])"
UNUSABLE = -100
MOST_MODELS = 10_000
RAIL_ORDER = ["input", "derived", "standby", "bias", "reference"]


def model_score(name: Column) -> Column:
    """How well a model's name suits; -100 for one that can't do the work. The minor version counts as an integer over ten."""
    s = F.lower(name)
    bonus = lambda found, points: F.when(found, F.lit(float(points))).otherwise(F.lit(0.0))
    major, minor = F.regexp_extract(s, VERSION, 1), F.regexp_extract(s, VERSION, 2)
    version = F.coalesce(major.try_cast("double") * 2, F.lit(0.0)) + F.coalesce(minor.try_cast("double") / 10, F.lit(0.0))
    points = bonus(s.contains("flash"), 30) + bonus(s.contains("pro"), 22) + bonus(s.contains("latest"), 15) + bonus(s.rlike("preview|exp|beta"), -10) + bonus(s.rlike(DATED), -5) + bonus(s.contains("lite"), -20) + version
    return F.when(s.rlike(UNFIT) | s.rlike(MAKES_IMAGES), F.lit(float(UNUSABLE))).otherwise(points)


def rank_models(models: DataFrame, name: str = "model", within: list[str] | None = None) -> DataFrame:
    """Usable models with score and rank (from 1): best first, then by name in the locale's order, then by its bytes.

    Without ``within`` all rows are one key's list, which one task ranks: of more than MOST_MODELS it is refused.
    """
    scored = models.withColumn("score", model_score(F.col(name))).where(F.col("score") > UNUSABLE)
    order = [F.col("score").desc(), F.collate(F.col(name), "UNICODE"), F.col(name)]
    if within:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
    if not models.offset(MOST_MODELS).isEmpty():
        raise ValueError(f"more than {MOST_MODELS} models: name the columns within which they are ranked")
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def best_model(models: DataFrame, name: str = "model") -> DataFrame:
    """One row with the first of the ranked models, '' if none is usable. A partial top-1 per task in the order of :func:`rank_models`, not a sort."""
    scored = models.withColumn("_score", model_score(F.col(name))).where(F.col("_score") > UNUSABLE)
    best = scored.agg(F.min(F.struct((-F.col("_score")).alias("s"), F.collate(F.col(name), "UNICODE").alias("l"), F.col(name).alias("n"))).alias("b"))
    return best.select(F.coalesce("b.n", F.lit("")).alias(name))


def next_untried(ranked: DataFrame, tried: DataFrame, name: str = "model", within: list[str] | None = None) -> DataFrame:
    """The best-ranked model that wasn't tried, per key of ``within`` if given."""
    left = ranked.join(tried.select(*(within or []), name).distinct(), [*(within or []), name], "left_anti")
    return left.groupBy(*(within or [])).agg(F.min_by(name, "rank").alias(name)).where(F.col(name).isNotNull())


def order_position(c: Column, order: list[str]) -> Column:
    """O1: place in a custom order, from 1; what isn't in it, or null, is 0 and sorts first. Sort by it and then by the input's position."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), c), F.lit(0)).cast("long")


def rotated(pos: Column, n: Column, start: Column) -> Column:
    """Position (from 0) of an item of a pool of n that begins at ``start``."""
    return F.pmod(pos - start, n)
