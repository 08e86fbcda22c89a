"""Daily allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAILY_CAP = 40  # fixed value: requests a day where none is configured


def utc_day(ts: Column) -> Column:
    """The day of a timestamp; the session's zone is to be UTC."""
    return F.to_date(ts)


def slot_key(who: Column, day: Column) -> Column:
    """The counter's key; an unknown caller shares one."""
    return F.concat(F.lit("rl:"), day.cast("string"), F.lit(":"), F.coalesce(who, F.lit("unknown")))


def reset_at(day: Column) -> Column:
    """When the day's counter starts anew."""
    return F.date_add(day, 1).cast("timestamp")


def percent_used(used: Column, cap: Column) -> Column:
    """Whole percent, halves up, at most 100; 0 without an allowance."""
    return F.when(cap <= 0, F.lit(0).cast("long")).otherwise(F.least(F.lit(100).cast("long"), F.floor(used * 100 / cap + 0.5).cast("long")))


def admit(requests: DataFrame, who: str, ts: str, order: list[str], cap: int = DAILY_CAP, salts: int = 1) -> DataFrame:
    """Every request with day, allowed (fewer than ``cap`` of the caller's day came before), used and remaining after it, and percent.

    Refused requests don't count. ``order`` breaks ties of ``ts``. One shuffle by caller and day. If a caller may have a large share
    of all requests in a day, ``salts`` cuts its day into as many parts: what isn't among a part's first ``cap`` is
    refused, and only the others, at most ``cap * salts`` a day, are counted together. The result is the same.
    """
    seen = requests.withColumn("day", utc_day(F.col(ts)))
    whole = [F.col(who), F.col("day")]
    if salts > 1:
        seen = seen.withColumn("_salt", F.pmod(F.xxhash64(ts, *order), F.lit(salts)))
        seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy(*whole, "_salt").orderBy(ts, *order)))
        whole.append(F.when(F.col("_n") > cap, F.col("_salt")))  # the refused stay apart
    place = F.row_number().over(Window.partitionBy(*whole).orderBy(ts, *order)).cast("long")
    seen = seen.withColumn("_place", F.when(F.col("_n") > cap, cap + 1).otherwise(place) if salts > 1 else place)
    used = F.least(F.col("_place"), F.lit(cap).cast("long"))
    return seen.withColumn("allowed", F.col("_place") <= cap).withColumn("used", used).withColumn("remaining", cap - used).withColumn("percent", percent_used(used, F.lit(cap))).drop("_n", "_salt", "_place")


def daily_usage(requests: DataFrame, who: str, ts: str, cap: int = DAILY_CAP) -> DataFrame:
    """A2: per caller and day: requests, used, remaining, refused, percent."""
    counted = requests.groupBy(who, utc_day(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    used = F.least("requests", F.lit(cap).cast("long"))
    return counted.select(who, "day", "requests", used.alias("used"), (cap - used).alias("remaining"), (F.col("requests") - used).alias("refused"), percent_used(used, F.lit(cap)).alias("percent"))


def allowance_from_headers(headers: Column) -> Column:
    """struct(enabled, limit, used, remaining, reset) from a map of response headers; null without a limit."""
    value = lambda name: F.try_element_at(headers, F.lit(name))
    number = lambda name: F.when(value(name).isNull(), F.lit(0.0)).otherwise(value(name).try_cast("double"))
    told = F.struct(F.lit(True).alias("enabled"), number("X-Quota-Limit").alias("limit"), number("X-Quota-Used").alias("used"), number("X-Quota-Remaining").alias("remaining"), F.coalesce(value("X-Quota-Reset"), F.lit("")).alias("reset"))
    return F.when(value("X-Quota-Limit").isNotNull(), told)


def allowance_from_json(body: Column) -> Column:
    """The same struct from a JSON body; null if it is no JSON object."""
    read = lambda name: F.get_json_object(body, f"$.{name}")
    number = lambda name: F.when(read(name).isNull(), F.lit(0.0)).otherwise(read(name).try_cast("double"))
    enabled = F.coalesce(~read("enabled").isin("false", "0", ""), F.lit(False))
    told = F.struct(enabled.alias("enabled"), number("limit").alias("limit"), number("used").alias("used"), number("remaining").alias("remaining"), F.coalesce(read("reset"), F.lit("")).alias("reset"))
    return F.when(F.get_json_object(body, "$").startswith("{"), told)
