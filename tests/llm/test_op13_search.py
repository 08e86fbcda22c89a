import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sheetloom.llm import queries, search

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k=50, once=True):
    """Rows (item_id, rank, doc_id, score) by plain loops."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc_id, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs // n_terms if n_terms else 0)
            score = 0
            for t, times in Counter(terms(text)).items():
                if t in bag:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += (1 if once else times) * weight * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if null else doc_id, -s) for r, (s, null, doc_id) in enumerate(sorted(found)[:k])]
    return out


def same(rows, want):
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want))


def test_query(spark, sf_dir):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    rows = queries.op13_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score")
    assert [(f.name, f.dataType.simpleString()) for f in rows.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    same(rows.collect(), brute(docs, items))


@pytest.mark.parametrize("once", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_random_texts_in_small_blocks(spark, monkeypatch, once, small):
    if small:
        monkeypatch.setattr(search, "ITEM_ENTRIES", 7)
        monkeypatch.setattr(search, "BLOCK_DOCS", 5)
        monkeypatch.setattr(search, "BLOCK_ENTRIES", 20)
        monkeypatch.setattr(search, "MOST_TERMS", 3)
        monkeypatch.setattr(search, "PARTS", 2)
    dice = random.Random(4)
    text = lambda n: " ".join(dice.choice("aa b Cc d9 é ee f g hh".split()) + dice.choice(["", ".", "-", "!"]) for _ in range(n))
    docs = [(dice.choice([None, i, i, -i, 7]), text(dice.randint(0, 15))) for i in range(120)] + [(5, "b b"), (5, "b b"), (3, "b b"), (None, "b b"), (1, None), (2, "")]
    items = [(str(i), text(dice.randint(0, 6))) for i in range(9)] + [(None, "aa"), ("x", None), ("y", ""), ("z", "absent"), ("0", "b"), ("0", "b"), ("long", text(60))]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string").repartition(2)
    want = brute(docs, items, 6, once)
    same(search.search(*frames, k=6, once=once).collect(), want)
    assert len(want) > 60


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "one two w5 x5"), (2, "ONE"), (3, None), (4, "日本 é"), (5, "the")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    same(search.search(odd_docs, bench).collect(), brute([(r[0], r[1]) for r in odd_rows], items))
    assert search.search(no_docs, bench).count() == 0 and search.search(odd_docs, bench.limit(0)).count() == 0
    clash = odd_docs.withColumnsRenamed({"rep": "query", "bucket": "block", "a": "terms", "start": "tf", "_bucket": "n"})
    same(search.search(clash, bench.selectExpr("item_id", "text", "1 AS query", "2 AS df")).collect(), brute([(r[0], r[1]) for r in odd_rows], items))


def test_impacts_of_very_long_texts_and_many_documents():
    tf, n = np.array([1, 5_000_000, 3]), np.array([10_000_000_000, 20_000_000, 1])
    n_docs, n_terms = 10**11, 10**14
    want = [10**9 * int(t) // (1000 * int(t) + 20 * (50 + 50 * int(x) * n_docs // n_terms)) for t, x in zip(tf, n, strict=True)]
    assert search.impacts(tf, n, n_docs, n_terms).tolist() == want
