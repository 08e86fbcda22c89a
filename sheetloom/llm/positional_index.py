"""Positional inverted index over a corpus, cut by document segments, with phrase and proximity search.

A segment is a bounded run of documents that one task read. Its words are numbered through; the posting
list of a term is the ascending list of the numbers at which the term stands. Between two documents a gap
is left, so no phrase spans documents. A phrase's occurrences are the intersection of its terms' lists,
each moved back by the term's offset, from the term that is rarest in the segment on. Segments are searched
apart: the index is shuffled once, by segment, and the terms that the stated queries use are selected
at the scan. Terms are 64-bit hashes of lower-cased words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import text_mark
from .words import LETTERS, slices, word_hashes

#: Words of a segment. Its lists take 4 bytes a word in storage and 8 in memory.
SEGMENT_WORDS = 3_000_000
#: Documents of a segment.
SEGMENT_DOCS = 50_000
#: Segments that a search task takes, about, one after another.
SEGMENTS_AT_ONCE = 8
#: Documents that are numbered before a segment's bounds are looked at again.
SLICE_DOCS = 8192
#: Numbers between the last word of a document and the first of the next: more than any phrase has, else phrases are refused.
GAP = 1 << 16
#: Terms of a query set that are sent to every task (8 bytes each); a larger vocabulary isn't restricted, all terms are indexed.
MOST_TERMS = 2_000_000
#: A segment's directory: a row without term that lists its documents, their words, and hashes of their texts.
SCHEMA = "segment long, term long, n long, positions binary, doc_ids array<long>, doc_words array<long>, doc_marks array<long>"


def build_index(docs: DataFrame, path: str, terms: np.ndarray | None = None) -> None:
    """Index every row's whole text (columns doc_id and text are used, others ignored) as Parquet at ``path``, sorted by term in each segment.

    ``terms``, sorted signed hashes, restricts the lists to the terms of a stated query set. A null or empty text has no
    words but stands in the directory; null and repeated doc_ids each keep their place. No rows give no segments.
    """
    wanted = terms.view(np.uint64).copy() if terms is not None and len(terms) <= MOST_TERMS else None
    if wanted is not None:
        wanted.sort()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        segment = (task.partitionId() if task else 0) << 32
        ids: list[int | None] = []
        counts: list[int] = []
        marks: list[int | None] = []
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        words = at = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal segment, ids, counts, marks, kept, words, at
            yield _rows(segment, [None], [len(ids)], [None], [ids], [counts], [marks])
            found = np.concatenate([t for t, _ in kept]) if kept else np.zeros(0, dtype=np.uint64)
            where = np.concatenate([p for _, p in kept]) if kept else np.zeros(0, dtype=np.int64)
            order = np.argsort(found.view(np.int64), kind="stable")
            found, where = found.view(np.int64)[order], where[order].astype("<u4")
            cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True]))) if len(found) else np.zeros(1, dtype=np.int64)
            for a in range(0, len(cuts) - 1, 2000):
                some = cuts[a : a + 2001].tolist()
                spans = list(zip(some[:-1], some[1:], strict=True))
                yield _rows(segment, [int(found[i]) for i, _ in spans], [j - i for i, j in spans], [_packed(where[i:j]) for i, j in spans], *[[None] * len(spans)] * 3)
            segment, ids, counts, marks, kept, words, at = segment + 1, [], [], [], [], 0, 0

        for batch in batches:
            for a, b in _few(batch.column(1)):
                hashed, before = word_hashes(batch.column(1).slice(a, b - a), LETTERS)
                lengths = np.diff(before)
                starts = at + np.concatenate(([0], np.cumsum(lengths + GAP)))
                places = np.arange(len(hashed)) + np.repeat(starts[:-1] - before[:-1], lengths)
                if wanted is not None:
                    near = np.minimum(np.searchsorted(wanted, hashed), max(len(wanted) - 1, 0))
                    hit = wanted[near] == hashed if len(wanted) else np.zeros(len(hashed), dtype=bool)
                    hashed, places = hashed[hit], places[hit]
                kept.append((hashed, places))
                ids += batch.column(0).slice(a, b - a).to_pylist()
                counts += lengths.tolist()
                marks += batch.column(2).slice(a, b - a).to_pylist()
                at, words = int(starts[-1]), words + int(lengths.sum())
                if words >= SEGMENT_WORDS or len(ids) >= SEGMENT_DOCS or at >= 1 << 31:
                    yield from flush()
        if ids:
            yield from flush()

    docs.select("doc_id", "text", text_mark().alias("text_mark")).mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def _few(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about 2 MB of text, of so few rows that the gaps between them don't lead beyond 32-bit numbers before a segment is closed."""
    for a, b in slices(texts):
        for at in range(a, b, SLICE_DOCS):
            yield at, min(at + SLICE_DOCS, b)


def _packed(places: np.ndarray) -> bytes:
    """Ascending numbers as their differences, little-endian: small ones, which the file format's compression shortens."""
    return np.diff(places, prepend=np.uint32(0)).astype("<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u4"), dtype=np.int64)


def _rows(segment: int, terms: list, n: list, positions: list, ids: list, counts: list, marks: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    names = ["segment", "term", "n", "positions", "doc_ids", "doc_words", "doc_marks"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[segment] * len(terms), terms, n, positions, ids, counts, marks], kinds, strict=True)], names)


@dataclass
class Segment:
    """Documents of one segment and the lists of the terms that the queries use."""

    doc_ids: list[int | None]
    words: np.ndarray
    starts: np.ndarray
    lists: dict[int, np.ndarray] = field(default_factory=dict)
    number: int = -1
    marks: list[int | None] = field(default_factory=list)

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Ascending numbers at which the terms stand one after another."""
        if len(terms) >= GAP:
            raise ValueError(f"a phrase has fewer than {GAP} words")
        rare = sorted(range(len(terms)), key=lambda i: len(self.lists.get(terms[i], ())))
        found = None
        for i in rare:
            places = self.lists.get(terms[i])
            if places is None:
                return np.zeros(0, dtype=np.int64)
            found = places - i if found is None else found[_in(found + i, places)]
            if not len(found):
                break
        return found if found is not None else np.zeros(0, dtype=np.int64)

    def near(self, terms: list[int], reach: int, anchor: int | None = None) -> np.ndarray:
        """Ascending numbers of the occurrences of ``anchor`` (one of the terms; else the rarest in the segment) that have each other term at most ``reach`` (under 65536) words away, in the same document."""
        if reach >= GAP:
            raise ValueError(f"a reach is less than {GAP} words")
        rare = sorted(set(terms), key=lambda t: (t != anchor, len(self.lists.get(t, ())), t))
        if not rare or any(t not in self.lists for t in rare):
            return np.zeros(0, dtype=np.int64)
        found = self.lists[rare[0]]
        for t in rare[1:]:
            places = self.lists[t]
            found = found[np.searchsorted(places, found - reach, side="left") < np.searchsorted(places, found + reach, side="right")]
        return found

    def documents(self, places: np.ndarray) -> np.ndarray:
        """Which of the segment's documents the numbers lie in."""
        return np.searchsorted(self.starts, places, side="right") - 1


def _in(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(places, values), len(places) - 1)
    return places[at] == values


def frequencies(spark: SparkSession, path: str, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``terms`` stands in the indexed texts. Of more than MOST_TERMS none is counted."""
    counts = np.zeros(len(terms), dtype=np.int64)
    if 0 < len(terms) <= MOST_TERMS:
        index = spark.read.schema(SCHEMA).parquet(path).where("term IS NOT NULL")
        stated = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.int64())}))
        found = index.join(F.broadcast(stated), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        counts[np.searchsorted(terms, found.column("term").to_numpy())] = found.column("n").to_numpy()
    return counts


def search(spark: SparkSession, path: str, terms: np.ndarray, query: Callable[[Segment], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``query`` to every segment of the index, with the lists of ``terms`` (signed hashes) at hand. Rows of ``schema``. The index can be searched as often as wanted."""
    index = spark.read.schema(SCHEMA).parquet(path)
    if len(terms) <= MOST_TERMS:
        stated = spark.createDataFrame(pa.table({"term": pa.array(np.unique(terms), pa.int64())}))
        index = index.where("term IS NULL").unionByName(index.where("term IS NOT NULL").join(F.broadcast(stated), "term", "left_semi").select(*index.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, here = None, None
        for batch in batches:
            columns = batch.columns
            for i, (number, term) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                if number != here:
                    if segment is not None:
                        yield query(segment)
                    words = np.array(columns[5][i].as_py(), dtype=np.int64)
                    segment, here = Segment(columns[4][i].as_py(), words, np.concatenate(([0], np.cumsum(words + GAP)[:-1])), number=number, marks=columns[6][i].as_py()), number
                else:
                    segment.lists[term] = _unpacked(columns[3][i].as_py())
        if segment is not None:
            yield query(segment)

    # As many partitions as segments need, so that a task's share doesn't grow with the corpus; a segment's directory, whose term is null, comes first.
    segments = spark.read.schema(SCHEMA).parquet(path).where("term IS NULL").count()
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-segments // SEGMENTS_AT_ONCE))
    return index.repartition(width, "segment").sortWithinPartitions(F.col("segment"), F.col("term").asc_nulls_first()).mapInArrow(run, schema)
