"""Connected components of a link table by alternating large-star and small-star steps.

Each step aggregates a minimum per node (combined before the shuffle) and joins it back to the edges from
two written tables, so a node with very many neighbours is split by Spark's skew handling. No edge,
label or component reaches the driver; only two numbers per round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, temporary


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """edges: (u, v) with u > v. Hang the neighbours of each node onto the least of them."""
    if both_ways:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = around.join(least, "u")
    if both_ways:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(hung.where("u <> v").distinct(), "star")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node (of any type that has an order) with a link: root is the least node reachable. Links with a null end or to the node itself are ignored; no links give no rows."""
    edges = materialize(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before, now = None, state(edges)
    while now[0] and now != before:
        with temporary(links.sparkSession) as keep:
            edges = keep(_star(_star(edges, True), False))
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
