"""Edge lists against their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune_edges(edges: DataFrame, nodes: DataFrame, source: str = "from", target: str = "to", node: str = "id", within: list[str] | None = None) -> DataFrame:
    """Edges whose two ends are nodes and differ. Repeated nodes count once; a null end is kept if a node is null, as in a set.

    ``within`` names columns that both tables hold (such as a report's id) inside which ends must match. The
    node ids are reduced to distinct ones before the semi joins; Spark broadcasts them only if they are small.
    """
    within = within or []
    ids = nodes.select(*[F.col(c).alias(f"_{c}") for c in within], F.col(node).alias("_node")).distinct()
    found = edges.where(~F.col(source).eqNullSafe(F.col(target)))
    for end in (source, target):
        same = F.col(end).eqNullSafe(F.col("_node"))
        for c in within:
            same = same & (F.col(c) == F.col(f"_{c}"))
        found = found.join(ids, same, "left_semi")
    return found


def first_seen(rows: DataFrame, value: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Each distinct value with the least of its order columns, as struct ``first``; sort by it to list values as first seen."""
    return rows.groupBy(*(within or []), value).agg(F.min(F.struct(*order)).alias("first"))
