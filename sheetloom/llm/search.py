"""Ranked lexical search as a blocked sparse matrix product.

Two sparse matrices: items by terms (how often an item holds a term; or once) and terms by documents (the 64-bit
integer impact of a term in a document). The first is cut into blocks of items, the second into blocks of documents. A
task multiplies block by block: an item's row is put together from the rows of its terms in a dense row of
integers (Gustavson's method), and only the best k of that row are kept, merged with the best of the blocks before.
What tasks keep is reduced once more by item. Terms are 64-bit hashes of lower-cased words; everything else is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize
from .words import LETTERS, slices, word_hashes

#: Item-term entries of a block of items, which goes to every task (16 bytes an entry there).
ITEM_ENTRIES = 1_000_000
#: Distinct terms of all items to which the documents' rows are restricted (8 bytes each in every task); with more, documents keep all their terms.
MOST_TERMS = 2_000_000
#: Documents and term-document entries of a block of documents.
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 1_000_000
#: Parts into which an item's candidates are dealt for the reduction before the last.
PARTS = 64
FORWARD = "doc_id long, n long, terms array<long>, tf array<long>"
FOUND = "query long, doc_id long, score long"


def forward(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """FORWARD: for each row of ``docs`` (doc_id and text are used, others ignored) its number of words, and its terms, ascending, with their occurrences; only those of the sorted ``vocabulary``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashed, before = word_hashes(batch.column(1).slice(a, b - a), LETTERS)
                terms, lengths = hashed.view(np.int64), np.diff(before)
                owner = np.repeat(np.arange(b - a), lengths)
                if vocabulary is not None:
                    kept = _at(vocabulary, terms)[1]
                    terms, owner = terms[kept], owner[kept]
                order = np.lexsort((terms, owner))
                terms, owner = terms[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])))) if len(terms) else np.zeros(0, dtype=np.int64)
                counts = np.diff(np.append(first, len(terms)))
                ends = pa.array(np.searchsorted(owner[first], np.arange(b - a + 1)), pa.int32())
                rows = [batch.column(0).slice(a, b - a), pa.array(lengths, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(v, pa.int64())) for v in (terms[first], counts))]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, FORWARD)


def _at(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in sorted ``known``, and whether it does."""
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return at, known[at] == values if len(known) else np.zeros(len(values), dtype=bool)


def item_rows(items: DataFrame) -> DataFrame:
    """query (a number for each row), block, item_id, terms and times of each row of ``items``; blocks hold at most ITEM_ENTRIES entries, or one item with more."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            blocks = []
            for n in pa.compute.list_value_length(batch.column(2)).to_pylist():
                if held and held + n > ITEM_ENTRIES:
                    block, held = block + 1, 0
                held += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blocks, pa.int64()), *batch.columns[1:]], ["query", "block", "item_id", "terms", "times"])

    numbered = materialize(items.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "items")
    terms = forward(numbered.select(F.col("query").alias("doc_id"), "text")).select(F.col("doc_id").alias("query"), "terms", F.col("tf").alias("times"))
    joined = numbered.select("query", "item_id").join(terms, "query").select("query", "item_id", "terms", "times")
    return joined.mapInArrow(run, f"query long, block long, item_id {kind}, terms array<long>, times array<long>")


@dataclass
class Items:
    """A block of items: numbers, and in compressed rows the terms and the integer weight of each."""

    queries: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def inverse_frequency(n_docs: int, df: int) -> int:
    """floor(1000 * ln((2N + 2) / (2df + 1))), in doubles: what a term that ``df`` of N documents hold weighs."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of each entry from its occurrences and its document's length, in 64-bit integers."""
    top = int(n.max(initial=0)) * 50 * n_docs
    share = (50 * n * n_docs) // n_terms if top < 1 << 63 else np.array([50 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + share))


class _Best:
    """The best k (score, doc_id) of each item so far: by score, then by doc_id, nulls last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, dtype=np.int64)] * n
        self.ids = [np.zeros(0, dtype=np.int64)] * n
        self.null = [np.zeros(0, dtype=bool)] * n

    def add(self, i: int, row: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        least = int(self.scores[i][-1]) if len(self.scores[i]) == self.k else 1
        some = np.flatnonzero(row >= max(least, 1))
        if len(some) > self.k:
            some = some[row[some] >= np.partition(row[some], -self.k)[-self.k]]
        if not len(some):
            return
        scores, own, none = np.append(self.scores[i], row[some]), np.append(self.ids[i], ids[some]), np.append(self.null[i], null[some])
        order = np.lexsort((own, none, -scores))[: self.k]
        self.scores[i], self.ids[i], self.null[i] = scores[order], own[order], none[order]


def _multiply(items: Items, lengths: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, scores of the block's documents) for each item that has a term in the block."""
    order = np.argsort(terms, kind="stable")
    terms, owner, tf = terms[order], owner[order], tf[order]
    cuts = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
    known, cuts = terms[cuts], np.append(cuts, len(terms)).tolist()
    impact = impacts(tf, lengths[owner], n_docs, n_terms)
    at, there = _at(known, items.terms)
    at, there, weights, starts = at.tolist(), there.tolist(), items.weights.tolist(), items.starts.tolist()
    for i in range(len(items.queries)):
        row = None
        for e in range(starts[i], starts[i + 1]):
            if there[e]:
                row = np.zeros(len(lengths), dtype=np.int64) if row is None else row
                a, b = cuts[at[e]], cuts[at[e] + 1]
                row[owner[a:b]] += weights[e] * impact[a:b]
        if row is not None:
            yield i, row


def best(rows: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """FOUND: for each item of a block the best k documents of each task's share of ``rows`` (FORWARD)."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, entries, docs = sent.value, [], 0, 0
        top = _Best(len(items.queries), k)

        def close() -> None:
            ids, lengths, sizes, terms, tf = (np.concatenate(c) for c in zip(*[h[:5] for h in held], strict=True))
            null = np.concatenate([h[5] for h in held])
            if len(terms):
                for i, row in _multiply(items, lengths, np.repeat(np.arange(len(ids)), sizes), terms, tf, n_docs, n_terms):
                    top.add(i, row, ids, null)

        for batch in batches:
            ids, n, terms, tf = batch.columns
            sizes = pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), n.to_numpy(), sizes, terms.flatten().to_numpy(), tf.flatten().to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            docs, entries = docs + batch.num_rows, entries + int(sizes.sum())
            if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                close()
                held, entries, docs = [], 0, 0
        if held:
            close()
        for i, q in enumerate(items.queries.tolist()):
            if len(top.scores[i]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids[i]), q)), pa.array(top.ids[i], mask=top.null[i]), pa.array(top.scores[i])], ["query", "doc_id", "score"])

    return rows.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int, within: list[str]) -> DataFrame:
    order = Window.partitionBy(*within).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, once: bool = True) -> DataFrame:
    """The best k documents of ``docs`` (doc_id and text are used, others ignored) for each row of ``items`` (item_id and text): item_id, rank (from 1), doc_id, score.

    Only scores above 0 count; equal ones are ordered by doc_id, nulls last. A term counts ``once`` for an item, or as often as the
    item holds it. Documents without terms, and null texts, match nothing and aren't counted; null and repeated doc_ids are rows of their
    own, and so are null and repeated item_ids; no documents or no items give no rows.
    """
    spark = docs.sparkSession
    stated = materialize(item_rows(items), "item-terms")
    words = stated.select(F.explode("terms").alias("term")).distinct().limit(MOST_TERMS + 1).toArrow().column("term").to_numpy()
    rows = materialize(forward(docs, np.sort(words) if len(words) <= MOST_TERMS else None), "forward")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = materialize(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    parts = []
    for a, b in _blocks(stated):
        block = stated.where(F.col("block").between(a, b))
        held = _items(spark, block, df, n_docs, once)
        if len(held.terms):
            near = best(rows, held, n_docs, n_terms, k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
            found = _ranked(_ranked(near, k, ["query", "part"]).drop("rank"), k, ["query"])
            parts.append(materialize(found.select("query", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        parts = [spark.createDataFrame([], "query long, rank int, doc_id long, score long")]
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    return told.join(stated.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _blocks(stated: DataFrame) -> list[tuple[int, int]]:
    """Ranges of block numbers, neighbours of which are put together as long as they are small."""
    joined: list[list[int]] = []
    for block, n in stated.groupBy("block").agg(F.sum(F.size("terms"))).orderBy("block").collect():
        if joined and joined[-1][2] + n <= ITEM_ENTRIES:
            joined[-1][1:] = block, joined[-1][2] + n
        else:
            joined.append([block, block, n])
    return [(a, b) for a, b, _ in joined]


def _items(spark: SparkSession, block: DataFrame, df: DataFrame, n_docs: int, once: bool) -> Items:
    """A block of items on the driver, without terms that no document holds."""
    own = block.select("query", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("query", "t.terms", "t.times")
    table = own.join(df, F.col("terms") == F.col("term")).select("query", "terms", "times", "df").orderBy("query", "terms").toArrow()
    query, terms, times, dfs = (table.column(i).to_numpy() for i in range(4))
    weights = {d: inverse_frequency(n_docs, d) for d in set(dfs.tolist())}
    weight = np.array([weights[d] for d in dfs.tolist()], dtype=np.int64)
    queries, starts = np.unique(query, return_index=True)
    return Items(queries, np.append(starts, len(query)), terms, weight if once else weight * times)
