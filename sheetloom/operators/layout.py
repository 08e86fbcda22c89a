"""Layered layout of a report's blocks and connections.

The rules are our own definition; what is given is that cycles are broken but their edges kept, layers are
longest paths, the order within layers follows barycentres, and edges between neighbouring layers go straight while all
others take a lane at the side. A report is a row and its graph a few arrays of it, so that nothing is
shuffled: names become numbers in columns, the graphs of many reports are placed together in numpy arrays, and
boxes and lines are columns again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import also

#: Our own measures: a block's box, the gaps between boxes, the width of a lane, and sweeps over the layers.
WIDTH, HEIGHT, GAP_X, GAP_Y, LANE = 168, 64, 32, 56, 14
SWEEPS = 4
#: Barycentres are compared as whole thousandths.
PARTS = 1000
#: Blocks and connections that are placed together; a larger report is placed alone.
TOGETHER = 200_000


def _cycles(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A number for each of n nodes that just those share from which each other can be reached, by edges from u to v.

    Edges that lie on no cycle are peeled off from the ends. Then, until none are left, the least label is carried along the edges, and what leads back to the
    node it came from has that node's number. Labels are shuffled, so that long rows of cycles take few rounds.
    """
    own, label = np.arange(n), np.random.default_rng(0).permutation(n)
    while len(u):
        entered, left = np.zeros(n, bool), np.zeros(n, bool)
        entered[v], left[u] = True, True
        kept = entered[u] & left[v]
        if not kept.all():
            u, v = u[kept], v[kept]
            continue
        least, before = label.copy(), None
        while before is None or (least != before).any():
            before = least.copy()
            np.minimum.at(least, v, before[u])
        back, same = entered & (least == label), least[u] == least[v]
        a, b = u[same], v[same]
        while len(more := a[back[b] & ~back[a]]):
            back[more] = True
        own[back] = n + least[back]
        kept = same & ~back[u] & ~back[v]
        u, v = u[kept], v[kept]
    return own


def _placed(blocks: np.ndarray, links: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Layers and places of the blocks, back edges and lanes (-1: straight) of the edges of many graphs that stand one after another, with so many blocks and links each."""
    first, n = np.cumsum(blocks) - blocks, int(blocks.sum())
    start = np.repeat(first, links)
    u, v = u + start, v + start
    own = _cycles(n, u, v)
    back = (v < u) & (own[u] == own[v])
    ahead_u, ahead_v = u[~back], v[~back]
    layer, depth, a, b = np.zeros(n, np.int64), 0, ahead_u, ahead_v
    while len(a):  # an edge stays as long as its begin has one that leads to it
        depth += 1
        layer[b] = depth
        entered = np.zeros(n, bool)
        entered[b] = True
        a, b = a[entered[a]], b[entered[a]]
    row = np.repeat(first, blocks) + layer
    begins = np.cumsum(np.bincount(row, minlength=n)) - np.bincount(row, minlength=n)
    place = np.empty(n, np.int64)

    def put(*by: np.ndarray) -> None:
        order = np.lexsort((*by, row))
        place[order] = np.arange(n) - begins[row[order]]

    put(np.arange(n))
    for sweep in range(SWEEPS):
        to, near = (ahead_v, ahead_u) if sweep % 2 == 0 else (ahead_u, ahead_v)
        count, total = np.bincount(to, minlength=n), np.bincount(to, place[near], n).astype(np.int64)
        put(place.copy(), np.where(count > 0, total * PARTS // np.maximum(count, 1), place * PARTS))
    side = back | (layer[v] - layer[u] != 1)
    before = np.cumsum(side) - side
    ends = np.cumsum(links)
    told = np.concatenate([[0], np.cumsum(side)])[ends - links]
    return layer, place, back, np.where(side, before - np.repeat(told, links), -1)


_PLACES = T.StructType([T.StructField(n, T.ArrayType(T.BooleanType() if n == "back" else T.IntegerType())) for n in ("layer", "place", "back", "lane")])


@F.arrow_udf(_PLACES)
def _graphs(blocks: pa.Array, u: pa.Array, v: pa.Array) -> pa.Array:
    """Graphs of so many blocks, with edges between blocks by number: layers and places, back edges and lanes, which straight edges have none of."""
    n, links = blocks.to_numpy(zero_copy_only=False).astype(np.int64), u.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begins, ends = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (u, v))
    at, nodes, edges = [*np.flatnonzero(np.diff(np.cumsum(n + links) // TOGETHER)) + 1, len(n)], np.cumsum(n), np.cumsum(links)
    parts, i = [], 0
    for j in at:
        some = slice(edges[i] - links[i], edges[j - 1]) if j > i else slice(0, 0)
        parts.append(_placed(n[i:j], links[i:j], begins[some], ends[some]))
        i = j
    layer, place, back, lane = (np.concatenate(x) for x in zip(*parts, strict=True))
    lists = lambda upto, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), values)
    columns = [lists(nodes, pa.array(layer, pa.int32())), lists(nodes, pa.array(place, pa.int32())), lists(edges, pa.array(back)), lists(edges, pa.array(lane, pa.int32(), mask=lane < 0))]
    return pa.StructArray.from_arrays(columns, _PLACES.names)


def layouts(reports: DataFrame, blocks: str = "blocks", connections: str = "connections") -> DataFrame:
    """``reports`` with ``nodes`` and ``edges`` (arrays of structs), ``width`` and ``height``, from arrays of blocks (field id) and connections (fields from and to).

    Blocks are taken by id, the first of each; a null id is one too. Connections whose ends aren't blocks, or are the same, have no edge.

    1. An edge is a back edge if it leads to an earlier block from which its own begin can be reached: each cycle has one.
    2. A block's layer is the number of edges of the longest path to it that has no back edge.
    3. Places within a layer begin in the blocks' order. SWEEPS times, by turns downwards and upwards, the blocks of all layers are put in
       order of the mean place of those before, or after, them; ties, and blocks without any, keep their order.
    4. An edge is straight if it leads to the next layer; else it has a lane at the right (``side``), numbered in the order of connections.

    Work grows with blocks x connections of a report, to find ends by their ids, and with connections x the longest path; memory with both
    of TOGETHER, or of the largest report. A report without blocks, or with null lists, has empty arrays and measures of 0.
    """
    key = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    told = also(reports, _ids=F.array_distinct(F.transform(F.coalesce(F.col(blocks), F.array()), lambda b: key(b["id"]))))
    ends = lambda c, i: F.struct((F.array_position("_ids", key(c["from"])) - 1).cast("int").alias("u"), (F.array_position("_ids", key(c["to"])) - 1).cast("int").alias("v"), i.alias("pos"))
    told = also(told, _edges=F.filter(F.transform(F.coalesce(F.col(connections), F.array()), ends), lambda e: (e["u"] >= 0) & (e["v"] >= 0) & (e["u"] != e["v"])))
    told = told.withColumn("_graph", _graphs(F.size("_ids"), F.col("_edges.u"), F.col("_edges.v")))
    told = told.select("*", *[F.col(f"_graph.{n}").alias(f"_{n}") for n in _PLACES.names])
    x, y = lambda i: F.get("_place", i) * (WIDTH + GAP_X), lambda i: F.get("_layer", i) * (HEIGHT + GAP_Y)
    name = lambda i: F.when(F.get("_ids", i) != "\x00", F.get("_ids", i))
    node = lambda layer, i: F.struct(name(i).alias("id"), layer.alias("layer"), F.get("_place", i).alias("place"), x(i).alias("x"), y(i).alias("y"), F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"))
    edge = lambda e, i: F.struct(
        e["pos"].alias("pos"), name(e["u"]).alias("from"), name(e["v"]).alias("to"), F.get("_back", i).alias("back"), F.get("_lane", i).isNotNull().alias("side"), F.get("_lane", i).alias("lane"),
        (x(e["u"]) + WIDTH // 2).alias("x1"), (y(e["u"]) + HEIGHT).alias("y1"), (x(e["v"]) + WIDTH // 2).alias("x2"), y(e["v"]).alias("y2"),
    )
    right, down = F.array_max("_place") * (WIDTH + GAP_X) + WIDTH, F.array_max("_layer") * (HEIGHT + GAP_Y) + HEIGHT
    lanes = F.coalesce(F.array_max("_lane") + 1, F.lit(0)) * LANE
    done = told.select("*", F.transform("_layer", node).alias("nodes"), F.transform("_edges", edge).alias("edges"), (F.coalesce(right, F.lit(0)) + lanes).alias("width"), F.coalesce(down, F.lit(0)).alias("height"))
    return done.drop(*[c for c in done.columns if c.startswith("_") and c not in reports.columns])
