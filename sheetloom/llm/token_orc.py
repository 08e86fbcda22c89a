"""Token ids in ORC: run-length-coded integers in stripes, row indexes and Bloom filters on document ids.

Documents are range-partitioned and sorted by doc_id, so each file, stripe and row group covers a narrow
id range: a reader can take stripes in parallel, skip them by their min/max, and by Bloom filter for ids
that fall into a range but aren't there. A row holds its document's whole ids and the ids before it in
its file; offsets across files come from one total per file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .storage import text_mark

SCHEMA = "part int, doc_id long, n_tokens long, part_start long, ids array<int>"
#: Files whose totals may be broadcast (16 bytes each); with more, the totals are joined by shuffle.
BROADCAST_PARTS = 100_000


def _lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(b) // 4 for b in encoded)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, row_index_stride: int = 1000, docs_at_once: int = 512) -> None:
    """Encode every row's whole text (columns doc_id and text are used, others ignored) and write ORC files at ``path``.

    Each document's ids end with ``end_id``; a null or empty text has that id alone. Rows are in ascending
    doc_id order over the files, null ids first; repeated ids each keep their row, in the order of a hash of the text and
    then of the text. Ranges are cut by doc_id, that hash and a random number, so neither a frequent id nor a frequent row fills a
    file. No rows give a table without rows.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        code, before = encoder(vocabulary).encode, 0
        for batch in batches:
            for at in range(0, batch.num_rows, docs_at_once):
                some = batch.slice(at, docs_at_once)
                encoded = code(some.column(1).to_pylist(), end_id)
                lengths = np.array([len(b) // 4 for b in encoded], dtype=np.int64)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(encoded), part, dtype=np.int32)), some.column(0), pa.array(lengths), pa.array(starts), _lists(encoded)],
                    ["part", "doc_id", "n_tokens", "part_start", "ids"],
                )

    spread = docs.select("doc_id", "text", F.coalesce(text_mark(), F.lit(0)).alias("mark"), F.rand(5).alias("spread"))
    ordered = spread.repartitionByRange("doc_id", "mark", "spread").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(row_index_stride), "orc.create.index": "true"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table as written: part, doc_id, n_tokens, part_start, ids. Filters on doc_id skip stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; only the row groups that may hold them are read."""
    return read_tokens(spark, path).where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def with_global_start(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (with part and part_start) and their ``start`` among all ids of the table ``tokens``."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    if totals.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    return rows.join(offsets, "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def digests(tokens: DataFrame) -> DataFrame:
    """part, doc_id, part_start, n_tokens (counted from the ids that were read) and ids_crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<i4", copy=False).view(np.uint8)
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "doc_id", "part_start", "n_tokens", "ids_crc32"])

    return tokens.select("part", "doc_id", "part_start", "ids").mapInArrow(run, "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long")
