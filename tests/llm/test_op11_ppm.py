import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sheetloom.llm import ppm, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


class Trie:
    """Byte contexts of all lengths up to ``order``, with plain dictionaries."""

    def __init__(self, texts, order):
        self.order, self.follow = order, defaultdict(Counter)
        for text in texts:
            for context, symbol in self.symbols(text):
                self.follow[context][symbol] += 1
        for k in range(order, 0, -1):  # a shorter context counts a symbol once for each longer one
            for context in [c for c in self.follow if len(c) == k]:
                self.follow[context[1:]].update(dict.fromkeys(self.follow[context], 1))

    def symbols(self, text):
        data = b"\xfe" * self.order + " ".join(words(text)).encode() + b"\xff"
        return [(data[i - self.order : i], data[i]) for i in range(self.order, len(data))]

    def cost(self, context, symbol):
        gone, total = set(), 0.0
        for k in range(self.order, -1, -1):
            found = self.follow.get(context[self.order - k :])
            if found is None:
                continue
            left = {s: n for s, n in found.items() if s not in gone}
            whole = 2 * sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / whole)
            if whole:
                total += math.log10(len(left) / whole)
            gone |= set(found)
        return total - math.log10(256 - len(gone))


def brute(rows, train, order=5):
    counts = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    trie = Trie(train, order)
    for doc_id, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        yield doc_id, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, sum(trie.cost(*x) for x in trie.symbols(text))


def same(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], round(r[5], 4))
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


@pytest.mark.parametrize("most", [1_000_000, 3000])
def test_query(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(ppm, "MOST_FREQUENT", most)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op11_byte_ppm(spark, sf_dir).collect()
    same(found, brute(docs, [t for i, t in docs if not held(i)]))
    assert all(r.held_out == held(r.doc_id) for r in found)
    assert 0 < sum(r.held_out for r in found) < len(found)


def test_better_than_single_words_on_texts_held_out(spark):
    found = queries.op11_byte_ppm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_costs_are_a_distribution(spark):
    train = ["abab abc", "abd", "ba ab", ""]
    model = ppm.fit(spark.createDataFrame([(t,) for t in train], "text string"), order=3)
    contexts = [b"aba", b"xab", b"zzz", b"\xfe\xfe\xfe", b" ab"]
    keys = [(int.from_bytes(c + bytes([s]), "big"),) for c in contexts for s in range(256)]
    table = spark.createDataFrame(keys, "key long")
    known = table.join(model.runs.select("key", "cost"), "key", "left")
    costs = known.where("cost IS NOT NULL").unionByName(ppm.unseen_costs(known.where("cost IS NULL").select("key"), model))
    sums = costs.groupBy(F.shiftright("key", 8).alias("c")).agg(F.sum(F.pow(F.lit(10.0), "cost")).alias("p"), F.count("*").alias("n")).collect()
    assert len(sums) == len(contexts) and all(r.p == pytest.approx(1) and r.n == 256 for r in sums)


@pytest.mark.parametrize("most", [1_000_000, 50, 0])
def test_odd_rows(spark, monkeypatch, odd_docs, odd_rows, no_docs, most):
    monkeypatch.setattr(ppm, "MOST_FREQUENT", most)
    monkeypatch.setattr(ppm, "HELD", 5000)
    train = [r[1] for r in odd_rows if not held(r[0])]
    same(ppm.score(odd_docs, ppm.fit(odd_docs.where(~ppm.held_out(F.col("doc_id"))), order=3)).collect(), brute([(r[0], r[1]) for r in odd_rows], train, 3))


def test_nothing_to_learn_from(spark, odd_docs, odd_rows, no_docs):
    model = ppm.fit(no_docs, order=2)
    few = odd_docs.where("doc_id BETWEEN 3 AND 6 OR doc_id IS NULL")
    same(ppm.score(few, model).collect(), brute([(r[0], r[1]) for r in odd_rows if r[0] is None or 3 <= r[0] <= 6], [], 2))
    assert ppm.score(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        ppm.fit(no_docs, order=7)
