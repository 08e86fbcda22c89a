"""Benchmark passages in a corpus, found by phrase search over a positional index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .positional_index import MOST_TERMS, SCHEMA, Segment, build_index, frequencies, search
from .storage import materialize, new_path
from .words import LETTERS, mix, word_hashes

#: Bytes of benchmark items that are gathered at a time: a block of the stated query set, which goes to every task (about 5 bytes there for each byte of text).
MOST_QUERY_BYTES = 8 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPANS = "spans array<struct<start:long,end:long>>"
HITS = "doc_id long, text_mark long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, " + SPANS
#: What a block finds in a document, which is told by its segment and its place in it.
PART = "segment long, at long, items array<string>, " + SPANS


@dataclass
class Windows:
    """Distinct windows of a query set as arrays: the items' words one after another, where each window begins and how many words it has, and which items have it."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    cuts: np.ndarray
    owner: np.ndarray
    names: pa.Array

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.words)

    def terms(self, i: int) -> list[int]:
        return self.words[self.first[i] : self.first[i] + self.size[i]].tolist()

    def items(self, i: int) -> list[str]:
        """Names of the items that have a window, for each of their rows."""
        return self.names.take(pa.array(self.owner[self.cuts[i] : self.cuts[i + 1]])).to_pylist()

    def within(self, terms: np.ndarray) -> np.ndarray:
        """The windows all of whose words are among sorted ``terms``."""
        if not len(terms):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(terms, self.words), len(terms) - 1)
        have = np.concatenate(([0], np.cumsum(terms[at] == self.words)))
        return np.flatnonzero(have[self.first + self.size] - have[self.first] == self.size)

    def rarest(self, vocabulary: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The term of each window that has the least count, or of those the least one."""
        order = np.lexsort((vocabulary, counts))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ranks = np.append(rank[np.searchsorted(vocabulary, self.words)], 0)
        ends = np.stack((self.first, self.first + self.size), axis=1).ravel()
        return vocabulary[order[np.minimum.reduceat(ranks, ends)[::2]]] if len(self.first) else np.zeros(0, dtype=np.int64)


def windows(items: DataFrame, words: int | None = 10) -> Windows:
    """All runs of ``words`` words of each item (columns item_id and text); an item with fewer words, but some, is one window; with None each item is one.

    A null text has none; a null item_id counts as the empty string. Gathers the items' texts on the driver; windows take about 5 bytes
    for each byte of text.
    """
    table = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toArrow()
    texts, names = table.column("text").combine_chunks(), table.column("item_id").combine_chunks()
    hashed, before = word_hashes(texts.cast(pa.string()), LETTERS) if len(texts) else (np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64))
    n = np.diff(before)
    size = n if words is None else np.minimum(n, words)
    many = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), many)
    first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + before[:-1][owner]
    size = size[owner]
    if words is None:
        return Windows(hashed.view(np.int64), first, size, np.arange(len(first) + 1), owner, names)
    padded, key = np.concatenate((hashed, np.zeros(words, dtype=np.uint64))), mix(size.astype(np.uint64))
    for j in range(words):
        key = np.where(j < size, mix(key * _STEP + padded[first + j]), key)
    _, at, which = np.unique(key, return_index=True, return_inverse=True)
    pairs = np.unique(which.astype(np.int64) * max(len(n), 1) + owner)
    cuts = np.searchsorted(pairs, np.arange(len(at) + 1) * max(len(n), 1))
    return Windows(hashed.view(np.int64), first[at], size[at], cuts, pairs % max(len(n), 1), names)


def _cut(text: bytes, most: int, words: int) -> list[bytes]:
    """Parts of at most about ``most`` bytes, each of which begins with the last ``words`` - 1 words of the one before: every run of ``words`` words is in one."""
    begins = np.array([m.start() for m in _WORD.finditer(text)], dtype=np.int64)
    parts, at = [], 0
    while at < len(begins):
        to = max(int(np.searchsorted(begins, begins[at] + most)), min(at + 2 * words, len(begins)))
        parts.append(text[begins[at] : begins[to] if to < len(begins) else len(text)])
        if to >= len(begins):
            break
        at = to - (words - 1)
    return parts


def blocks(items: DataFrame, words: int | None = None) -> list[DataFrame]:
    """The items in blocks of at most about MOST_QUERY_BYTES bytes. A small query set is one block as it is.

    With ``words``, a larger item is cut into parts that overlap by as many words less one; without it, it is a block of its own.
    """
    table = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0))
    if (table.agg(F.sum(size)).first()[0] or 0) <= MOST_QUERY_BYTES:
        return [table]
    most = MOST_QUERY_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = len((item or "").encode())
                for part in [text] if words is None or len(text) <= most else _cut(text, most, words):
                    if held and held + own + len(part) > most:
                        block, held = block + 1, 0
                    held += own + len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([part], pa.binary()).cast(pa.string()), pa.array([own + len(part)]), pa.array([block])], ["item_id", "text", "size", "block"])

    rows = table.where("text IS NOT NULL").select("item_id", "text")
    numbered = materialize(rows.mapInArrow(number, "item_id string, text string, size long, block long"), "items")
    joined: list[list[int]] = []
    for block, n in numbered.groupBy("block").agg(F.sum("size")).orderBy("block").collect():
        if joined and joined[-1][2] + n <= most:
            joined[-1][1:] = block, joined[-1][2] + n
        else:
            joined.append([block, block, n])
    return [numbered.where(F.col("block").between(a, b)).select("item_id", "text") for a, b, _ in joined]


def vocabulary(items: Iterable[DataFrame]) -> np.ndarray | None:
    """The sorted hashes of all the items' words; None if they are more than an index is restricted to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = np.unique(word_hashes(batch.column(0).cast(pa.string()), LETTERS)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hashed)], ["term"])

    found = np.zeros(0, dtype=np.int64)
    for block in items:
        own = block.select("text").mapInArrow(run, "term long").distinct().limit(MOST_TERMS + 1).toArrow().column("term")
        found = np.union1d(found, own.to_numpy())
        if len(found) > MOST_TERMS:
            return None
    return found


def _merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that overlap or touch made one."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(begins) - 1]))
    return begins[new], ends[last]


def _search(segment: Segment, queries: Windows) -> tuple[dict[int, set[str]], dict[int, list[dict[str, int]]]]:
    """The items and the merged spans found in each of the segment's documents that has any."""
    covered: list[tuple[np.ndarray, int]] = []
    owners: dict[int, set[str]] = {}
    for i in queries.within(np.array(sorted(segment.lists), dtype=np.int64)).tolist():
        terms = queries.terms(i)
        places = segment.phrase(terms)
        if len(places):
            covered.append((places, len(terms)))
            names = queries.items(i)
            for d in np.unique(segment.documents(places)).tolist():
                owners.setdefault(d, set()).update(names)
    rows = {d: [] for d in owners}
    if covered:
        begins, ends = _merged(np.concatenate([p for p, _ in covered]), np.concatenate([p + k for p, k in covered]))
        for d, a, b in zip(segment.documents(begins).tolist(), begins.tolist(), ends.tolist(), strict=True):
            at = int(segment.starts[d])
            rows[d].append({"start": a - at, "end": b - at})
    return owners, rows


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _told(doc_ids: list[int | None], marks: list[int | None], words: list[int], found: list[list[str]], spans: list[list[dict[str, int]]]) -> pa.RecordBatch:
    """Rows of HITS, from sorted items and merged spans."""
    hits = [sum(s["end"] - s["start"] for s in own) for own in spans]
    digest = [hashlib.sha256(",".join(f).encode()).hexdigest() for f in found]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), _SPANS]
    values = [doc_ids, marks, words, hits, [len(f) for f in found], found, digest, [h > 0 for h in hits], spans]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "text_mark", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"])


def contamination(docs: DataFrame, items: DataFrame, words: int = 10) -> DataFrame:
    """Every row of ``docs`` (columns doc_id and text are used, others ignored) with the words that lie in occurrences of the items' windows.

    Returns doc_id, text_mark (a hash of the text), n_words, n_hit, n_items, items (sorted), items_sha256 (of the comma-joined items),
    contaminated, and spans: the hit runs of words, as word numbers from 0, end excluded. A null or empty
    text has no words and no hits; null and repeated doc_ids each keep their row; no documents or no
    items give no hits. A query set of more than one block is searched block by block over one index, and
    what the blocks find is merged by document row.
    """
    spark = docs.sparkSession
    path = new_path(spark, "positions")
    parts = blocks(items, words)
    if len(parts) > 1:
        build_index(docs, path, vocabulary(parts))
        return _merge(docs, path, parts, words)
    stated = windows(parts[0], words)
    terms = stated.vocabulary()
    build_index(docs, path, terms)
    sent = spark.sparkContext.broadcast(stated)

    def query(segment: Segment) -> pa.RecordBatch:
        owners, rows = _search(segment, sent.value)
        n = len(segment.doc_ids)
        return _told(segment.doc_ids, segment.marks, segment.words.tolist(), [sorted(owners.get(d, ())) for d in range(n)], [rows.get(d, []) for d in range(n)])

    return search(spark, path, terms, query, HITS)


def _merge(docs: DataFrame, path: str, parts: list[DataFrame], words: int) -> DataFrame:
    """Search the index for each block, one after another, and put together what they find in a document row."""
    spark = docs.sparkSession
    found = new_path(spark, "hits")
    for part in parts:
        _search_block(path, found, part, words)
    hits = spark.read.schema(PART).parquet(found).groupBy("segment", "at").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    rows = spark.read.schema(SCHEMA).parquet(path).where("term IS NULL").select("segment", F.posexplode(F.arrays_zip("doc_ids", "doc_words", "doc_marks")).alias("at", "doc"))
    rows = rows.select("segment", F.col("at").cast("long").alias("at"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.doc_marks").alias("text_mark"), F.col("doc.doc_words").alias("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, counts, items, spans = (c.to_pylist() for c in batch.columns)
            merged = []
            for own in spans:
                runs = _merged(np.array([s["start"] for s in own]), np.array([s["end"] for s in own])) if own else ((), ())
                merged.append([{"start": int(a), "end": int(b)} for a, b in zip(*runs, strict=True)])
            yield _told(ids, marks, counts, [sorted(set(f or ())) for f in items], merged)

    return rows.join(hits, ["segment", "at"], "left").select("doc_id", "text_mark", "n_words", "items", "spans").mapInArrow(run, HITS)


def _search_block(path: str, found: str, part: DataFrame, words: int) -> None:
    """Append rows of PART for the documents in which a block's windows occur."""
    spark = part.sparkSession
    stated = windows(part, words)
    sent = spark.sparkContext.broadcast(stated)

    def query(segment: Segment) -> pa.RecordBatch:
        owners, rows = _search(segment, sent.value)
        hit = sorted(owners)
        values = [[segment.number] * len(hit), hit, [sorted(owners[d]) for d in hit], [rows[d] for d in hit]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["segment", "at", "items", "spans"])

    search(spark, path, stated.vocabulary(), query, PART).write.mode("append").option("compression", "zstd").parquet(found)
    sent.destroy()


PROXIMITY = "doc_id long, text_mark long, item_id string, positions array<long>"


def proximity(docs: DataFrame, items: DataFrame, reach: int = 20) -> DataFrame:
    """Documents (columns doc_id and text) that hold all distinct words of an item (item_id and text) near the one of them that is rarest in the corpus.

    Returns doc_id, text_mark, item_id and positions: the word numbers, from 0, of that rarest word's occurrences that have each other
    word of the item at most ``reach`` words away. Items without words, and null texts, match nothing; null item_ids count as
    the empty string; repeated items give their rows each. Items are searched in blocks, as phrases are.
    """
    spark = docs.sparkSession
    path, found = new_path(spark, "positions"), new_path(spark, "near")
    parts = blocks(items)
    build_index(docs, path, vocabulary(parts))
    for part in parts:
        stated = windows(part, words=None)
        terms = stated.vocabulary()
        sent = spark.sparkContext.broadcast((stated, stated.rarest(terms, frequencies(spark, path, terms))))

        def query(segment: Segment, sent: Broadcast = sent) -> pa.RecordBatch:
            (queries, rarest), rows = sent.value, []
            for i in queries.within(np.array(sorted(segment.lists), dtype=np.int64)).tolist():
                places = segment.near(queries.terms(i), reach, anchor=int(rarest[i]))
                owners = segment.documents(places)
                for d in np.unique(owners).tolist():
                    at = (places[owners == d] - segment.starts[d]).tolist()
                    rows += [(segment.doc_ids[d], segment.marks[d], item, at) for item in queries.items(i)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            values = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["doc_id", "text_mark", "item_id", "positions"])

        search(spark, path, stated.vocabulary(), query, PROXIMITY).write.mode("append").option("compression", "zstd").parquet(found)
        sent.destroy()
    return spark.read.schema(PROXIMITY).parquet(found)
