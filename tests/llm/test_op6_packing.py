import heapq
import os
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheetloom.llm import packing, queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 300))
def test_windows_hold_all_items_within_capacity(sizes, capacity):
    found = packing.windows(sizes, capacity)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= capacity for w in found)


@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.integers(1, 8))
def test_differencing_is_a_partition(sizes, k):
    found = packing.difference(sizes, k)
    assert len(found) == max(k, len(found)) and sorted(i for w in found for i in w) == list(range(len(sizes)))


def dense(sizes, k):
    """The sums of multiway differencing by its definition: every partial partition has all k windows."""
    heap = [(-s, turn, [s] + [0] * (k - 1)) for turn, s in enumerate(sorted(sizes, reverse=True))]
    turn = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], turn, both))
        turn += 1
    return heap[0][2]


@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(1, 9))
def test_sparse_partitions_give_the_sums_of_dense_ones(sizes, k):
    got = sorted((sum(sizes[i] for i in w) for w in packing.difference(sizes, k)), reverse=True)
    assert got == dense(sizes, k) or len(sizes) <= k


def test_a_block_of_tiny_texts_stays_small():
    """400,000 texts of one token, in a process of its own: its peak memory is measured."""
    code = """
import resource
from sheetloom.llm import packing
found = packing.windows([1] * 400_000, 2048)
assert sum(map(len, found)) == 400_000 and max(map(len, found)) <= 2048 and len(found) == 196
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) < 500, said


def test_null_texts_only(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text").coalesce(1)
    rows = packing.pack(docs, block_windows=4).collect()
    assert len(rows) == 20_000 and {(r.length, r.doc_tokens) for r in rows} == {(1, 1)}
    assert len({r.sequence_id for r in rows}) == -(-20_000 // 2048) and len({(r.sequence_id, r.offset) for r in rows}) == 20_000


def test_differencing_is_near_equal():
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 512, 400)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 50)]
    assert max(sums) - min(sums) < 0.02 * sum(sizes) / 50


def check(rows, docs, window=2048, end=1):
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # the library as it is
    ids = [np.array([*(code.encode(t, add_special_tokens=False).ids if t else []), end], dtype="<u4") for _, t in docs]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(b.offset == a.offset + a.length for a, b in zip(own[:-1], own[1:], strict=True))
        assert sum(r.length for r in own) <= window
    assert sum(r.length for r in rows) == sum(map(len, ids))
    for (doc_id, _), own in zip(docs, ids, strict=True):
        if sum(d == doc_id for d, _ in docs) == 1:
            pieces = sorted(by_doc[doc_id], key=lambda r: r.start)
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
            assert all((r.ids_crc32, r.doc_tokens) == (zlib.crc32(own[r.start : r.start + r.length].tobytes()), len(own)) for r in pieces)
            assert sum(r.length for r in pieces) == len(own)
    return sum(r.length for r in rows) / (window * len(by_sequence))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(queries.op6_differencing_windows(spark, sf_dir).collect(), docs) > 0.97


def test_odd_rows(odd_docs, odd_rows, no_docs):
    from pyspark.sql import functions as F

    rows = packing.pack(odd_docs, window=64, piece=16).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, [(r[0], r[1]) for r in odd_rows], window=64)
    assert packing.pack(no_docs).count() == 0
