"""Values of many keys looked up for many rows, where the table of values grows with the corpus.

The most frequent keys, at most a stated number, go to every task; all others are joined by shuffle. As the
frequent ones leave first, no key that is shuffled holds a large share of the rows, and few rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEPS = 16


def least_frequent(counts: DataFrame, n: str, most: int) -> int:
    """The least count such that at most ``most`` rows of ``counts`` have it or more; 1 if that are all. Counts (from 1) are put into 16 classes for each power of two, so what is gathered is at most a thousand rows."""
    step = F.floor(F.log2(n) * _STEPS)
    classes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least"), F.max(n).alias("greatest")).orderBy(F.desc("step")).collect()
    held, least = 0, (classes[0].greatest + 1 if classes else 1)
    for c in classes:
        held += c.rows
        if held > most:
            return least
        least = c.least
    return 1


def sums(links: DataFrame, values: DataFrame, row: str, key: str, of: list[str], n: str, most: int) -> DataFrame:
    """For each ``row`` of ``links`` (row, key) the sums of the columns ``of`` of its keys' rows in ``values``: (row, *of). Every key is in ``values``, once; ``n`` is how often it is in ``links``.

    Rows of ``links`` that belong together lie together, so both sums are combined before their shuffle.
    """
    least = least_frequent(values, n, most)
    often, seldom = values.where(F.col(n) >= least).select(key, *of), values.where(F.col(n) < least).select(key, *of)
    add = [F.sum(c).alias(c) for c in of]
    found = links.join(F.broadcast(often), key).groupBy(row).agg(*add)
    if least <= 1:
        return found
    rest = links.join(F.broadcast(often.select(key)), key, "left_anti").groupBy(row, key).agg(F.count(F.lit(1)).alias("_times"))
    rest = rest.join(seldom.hint("merge"), key).groupBy(row).agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in of])
    return found.unionByName(rest).groupBy(row).agg(*add)
