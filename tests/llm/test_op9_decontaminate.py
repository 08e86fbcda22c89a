import hashlib
import os
import pickle
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import decontaminate, positional_index, queries
from sheetloom.llm.storage import new_path
from sheetloom.llm.words import LETTERS, word_hashes

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    found = {}
    for item, text in items:
        w = words(text)
        for a in range(max(len(w) - k, 0) + 1 if w else 0):
            found.setdefault(tuple(w[a : a + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(f) for f in found}:
            for a in range(len(w) - n + 1):
                if (t := tuple(w[a : a + n])) in found:
                    hit.update(range(a, a + n))
                    own |= found[t]
        out.append((doc_id, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def same(rows, want):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)


def read(spark, path):
    return [tuple(r)[:2] for r in spark.read.parquet(path).select(*spark.read.parquet(path).columns[:2]).collect()]


def test_query(spark, sf_dir):
    want = brute(read(spark, f"{sf_dir}/documents.parquet"), read(spark, f"{sf_dir}/benchmark.parquet"), 10)
    rows = queries.op9_positional_hits(spark, sf_dir).collect()
    same(rows, want)
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_random_texts_in_small_segments(spark, monkeypatch):
    monkeypatch.setattr(positional_index, "SEGMENT_WORDS", 50)
    dice = random.Random(7)
    text = lambda n: " ".join(dice.choice("aa b Cc d9 é".split()) + dice.choice(["", ".", "-", "!"]) for _ in range(n))
    docs = [(i, text(dice.randint(0, 40))) for i in range(80)]
    items = [(i, text(dice.randint(0, 6))) for i in range(12)] + [(None, "aa b Cc"), (5, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(*frames, words=4).collect()
    same(rows, brute(docs, items, 4))
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans[:-1], r.spans[1:], strict=True))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "two three four five six seven eight nine ten eleven"), (2, "one"), (3, ""), (4, None), (5, "w3 x3 w4 x4 w5 x5 w6 x6 w7 x7 w8 x8")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.contamination(odd_docs, bench).collect(), brute([(r[0], r[1]) for r in odd_rows], items, 10))
    assert decontaminate.contamination(no_docs, bench).count() == 0
    none = decontaminate.contamination(odd_docs, bench.limit(0)).collect()
    assert len(none) == len(odd_rows) and not any(r.contaminated for r in none)


def test_proximity(spark):
    dice = random.Random(3)
    docs = [(i, " ".join(dice.choice("abcdefgh") for _ in range(30))) for i in range(30)]
    path = new_path(spark, "i")
    positional_index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), path)
    import pyarrow as pa

    names = ["a", "c", "h"]
    terms = word_hashes(pa.array([" ".join(names)]), LETTERS)[0].view(np.int64)

    def query(segment):
        rare = min(terms.tolist(), key=lambda t: (len(segment.lists.get(t, ())), t))
        at = segment.near(terms.tolist(), 2)
        d = segment.documents(at)
        return pa.RecordBatch.from_pydict({"doc_id": [segment.doc_ids[i] for i in d], "at": at - segment.starts[d], "rare": [terms.tolist().index(rare)] * len(at)}, pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("rare", pa.int64())]))

    rows = positional_index.search(spark, path, terms, query, "doc_id long, at long, rare long").collect()
    for r in rows:
        near = docs[r.doc_id][1].split()[max(0, r.at - 2) : r.at + 3]
        assert docs[r.doc_id][1].split()[r.at] == names[r.rare] and set(names) <= set(near)
    rare = {r.rare for r in rows}
    if len(rare) == 1:
        n = names[rare.pop()]
        want = sum(x == n and set(names) <= set(w[max(0, i - 2) : i + 3]) for _, t in docs for w in [t.split()] for i, x in enumerate(w))
        assert len(rows) == want
    with pytest.raises(ValueError):
        positional_index.Segment([], np.zeros(0), np.zeros(0)).near([1], 1 << 16)


@pytest.mark.parametrize("most", [8 << 20, 12])
def test_proximity_matches_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(positional_index, "SEGMENT_WORDS", 200)
    monkeypatch.setattr(decontaminate, "MOST_QUERY_BYTES", most)
    dice = random.Random(8)
    docs = [(i % 25, " ".join(dice.choice("abcdefgh" * 3 + "yz") for _ in range(dice.randint(0, 40)))) for i in range(40)] + [(None, "y a z"), (1, None), (2, "")]
    items = [("p", "z a c"), ("q", "Y, h"), ("q", "y h"), ("r", "absent a"), ("s", ""), ("t", None), (None, "z"), ("u", "b b")]
    counts = Counter(w for _, t in docs for w in words(t))
    want = Counter()
    for doc_id, text in docs:
        said = words(text)
        for item, query in items:
            terms = set(words(query))
            if terms and all(counts[t] for t in terms):
                anchors = [t for t in terms if counts[t] == min(counts[u] for u in terms)]
                assert len(anchors) == 1
                at = tuple(i for i, w in enumerate(said) if w == anchors[0] and terms <= set(said[max(0, i - 4) : i + 5]))
                if at:
                    want[doc_id, item or "", at] += 1
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    rows = decontaminate.proximity(*frames, reach=4).collect()
    got = Counter((r.doc_id, r.item_id, tuple(r.positions)) for r in rows)
    assert set(got) == set(want) and len(want) > 5


def test_a_large_query_set_is_searched_in_blocks(spark, monkeypatch, odd_docs, odd_rows):
    monkeypatch.setattr(positional_index, "SEGMENT_WORDS", 50)
    dice = random.Random(11)
    text = lambda n: " ".join(dice.choice("aa b Cc d9 é".split()) for _ in range(n))
    docs = [(i % 30 if i % 7 else None, text(dice.randint(0, 40))) for i in range(80)] + [(1, None)]
    items = [(i, text(dice.randint(0, 30))) for i in range(40)] + [(None, "aa b Cc"), (5, None), (3, "b b b b"), (8, text(3000))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    whole = decontaminate.contamination(*frames, words=4).collect()
    monkeypatch.setattr(decontaminate, "MOST_QUERY_BYTES", 300)
    assert len(decontaminate.blocks(frames[1])) > 3
    rows = decontaminate.contamination(*frames, words=4).collect()
    same(rows, brute(docs, items, 4))
    assert sorted(map(repr, rows)) == sorted(map(repr, whole))
    bench = [(1, "two three four five six seven eight nine ten eleven"), (2, "one"), (5, "w3 x3 w4 x4 w5 x5 w6 x6 w7 x7 w8 x8" + " y" * 300)]
    same(decontaminate.contamination(odd_docs, spark.createDataFrame(bench, "item_id long, text string")).collect(), brute([(r[0], r[1]) for r in odd_rows], bench, 10))


def test_many_short_texts_in_one_batch(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "200000")
    try:
        docs = spark.range(120_000).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 90007, "here it is").otherwise("word").alias("text"))
        hits = decontaminate.contamination(docs, spark.createDataFrame([(1, "here it is")], "item_id long, text string")).where("contaminated").collect()
    finally:
        spark.conf.set(name, before)
    assert [(r.doc_id, r.n_hit) for r in hits] == [(90007, 3)]


def test_a_block_of_the_full_size_is_small_in_a_worker(spark, tmp_path):
    dice = np.random.default_rng(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda: " ".join("".join(letters[j] for j in dice.integers(0, 26, 5)) for _ in range(690))
    items = [(i, text()) for i in range(decontaminate.MOST_QUERY_BYTES // 4140)]
    stated = decontaminate.windows(spark.createDataFrame(items, "item_id long, text string"))
    assert len(stated.first) > 1_300_000
    (tmp_path / "windows").write_bytes(pickle.dumps(stated))
    code = f"import pickle, re; w = pickle.load(open({str(tmp_path / 'windows')!r}, 'rb')); w.within(w.vocabulary()[::2].copy()); print(int(re.search('VmHWM:\\\\s+(\\\\d+)', open('/proc/self/status').read())[1]) // 1024)"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(said.stdout) < 300


def test_items_larger_than_a_block_are_cut(spark, monkeypatch):
    dice = random.Random(13)
    long = " ".join(dice.choice("aa b Cc d9 é ff gg".split()) for _ in range(700))
    docs = [(i, " ".join(long.split()[a : a + 15])) for i, a in enumerate(range(0, 700, 13))] + [(900, long), (901, "aa b")]
    items = [(1, long), (2, long[500:900]), (3, "aa b"), (4, "x" * 500)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MOST_QUERY_BYTES", 200)
    assert len(decontaminate.blocks(frames[1], 6)) > 8
    same(decontaminate.contamination(*frames, words=6).collect(), brute(docs, items, 6))
