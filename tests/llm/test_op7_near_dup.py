import random
import re
from collections import Counter

import numpy as np
import pytest

from sheetloom.llm import near_dup, queries, sketch
from sheetloom.llm.components import components
from sheetloom.llm.words import mix

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(docs, k, percent=80):
    """doc_id -> (set size, least reachable id), from all pairs."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for n, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(n)
    for n, (i, s) in enumerate(sets):
        for m, both in Counter(m for x in s for m in where[x] if m < n).items():
            j, t = sets[m]
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_duplicates(spark, sf_dir).collect()}
    assert got == brute(docs, 2)


def chain(n, words=60, step=2, seed=0):
    """Texts each of which changes a few words of the one before: neighbours are linked, the ends aren't."""
    dice, text, out = random.Random(seed), [f"v{i}" for i in range(words)], []
    for i in range(n):
        out.append(" ".join(text))
        for j in range(step):
            text[(i * step + j) % words] = f"n{dice.random()}"
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_large_groups_in_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    dice = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    texts = ["same text in many rows of it"] * 40 + chain(25) + [" ".join(dice.choice([w] * 14 + [f"r{dice.random()}"]) for w in base) for _ in range(60)]
    docs = list(enumerate(texts))
    dice.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame, words=2).collect()}
    assert got == brute(docs, 2)


@pytest.mark.parametrize(("share", "direct"), [(3, 1), (1000, 2), (1000, 24)])
def test_boilerplate_in_large_buckets(spark, monkeypatch, share, direct):
    """Texts that have 60 % in common meet in buckets by their common words, but only near copies are linked."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near_dup, "DIRECT_BLOCKS", direct)
    monkeypatch.setattr(near_dup, "FREQUENT_SHARE", share)
    dice = random.Random(9)
    common = " ".join(f"c{i}" for i in range(60))
    own = lambda n: " ".join(f"o{dice.random()}" for _ in range(n))
    texts = [f"{common} {own(25)}" for _ in range(120)]
    texts += [t + " x y" for t in texts[:30]] + [t + " z" for t in texts[10:40]] + ["short one here", "short one here too"]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame, words=2, bands=40, rows=2).collect()}
    assert got == brute(docs, 2)


def test_rows_that_are_compared_on_boilerplate(spark, monkeypatch):
    """Texts of which none are linked, made of the same sentences: each is shipped to blocks a few dozen times, whatever their number."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    shipped, verify = [], near_dup._verify
    monkeypatch.setattr(near_dup, "_verify", lambda members, *rest: (shipped.append(members.count()), verify(members, *rest))[1])
    dice = random.Random(3)
    sentences = [" ".join(f"w{i}x{j}" for j in range(6)) for i in range(60)]
    rows = {}
    for n in (500, 1000):
        docs = [(i, " ".join(s for s in sentences if dice.random() < 0.5)) for i in range(n)]
        shipped.clear()
        assert near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).where("kept").count() == n
        rows[n] = sum(shipped)
    assert rows[500] < 20 * 500 and rows[1000] < 30 * 1000 and rows[1000] < 3.5 * rows[500]


def test_repeated_ids_with_different_texts(spark):
    a, b, b2 = ("one two three four five six seven eight nine ten " + x for x in ("a b c d e f g h", "k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0", "k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0 also"))
    rows = [(3, a), (7, a), (7, b), (9, b)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = near_dup.near_duplicates(frame, words=5).collect()
    assert Counter((r.doc_id, r.component_id, r.kept, r.first) for r in got) == Counter([(3, 3, True, True), (7, 3, False, False), (7, 7, True, True), (9, 7, False, False)])
    assert sorted((r.doc_id, r.text) for r in near_dup.one_of_each(frame).collect()) == [(3, a), (7, b)]
    # Ties: two near texts under one id, whole rows that repeat, rows without an id.
    rows = [(7, b, 4), (7, b2, 3), (7, b, 2), (9, b2, 1), (None, a, 1), (None, a, 1), (None, None, 5), (None, None, 5), (4, "", 1), (4, "", 0), (5, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = near_dup.near_duplicates(frame, words=5).collect()
    assert all(r.component_id == 7 and r.kept == (r.doc_id == 7) for r in got if r.n_shingles > 10 and r.doc_id)
    kept = sorted(map(tuple, near_dup.one_of_each(frame).collect()), key=repr)
    assert len(kept) == 5 and {k for k in kept if k[0] != 7} == {(None, a, 1), (None, None, 5), (4, "", 0), (5, "", 1)}
    assert [k for k in kept if k[0] == 7] in ([(7, b, 2)], [(7, b2, 3)])


def test_linked_is_exact():
    dice = np.random.default_rng(2)
    for _ in range(30):
        base = mix(np.arange(1, 60, dtype=np.uint64))
        sets = [np.unique(np.concatenate((base[dice.random(59) < 0.93], mix(dice.integers(1000, 2**60, 3).astype(np.uint64))))) for _ in range(12)]
        ok = lambda a, b: 100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n)
        left = [i < 5 for i in range(12)]
        for within in (True, False):
            found, want = near_dup._Forest(12), near_dup._Forest(12)
            for i, j in near_dup.linked(sets, left, within, 80):
                assert ok(sets[i], sets[j])
                found.join(i, j)
            for i in range(12):
                for j in range(i):
                    if (within or left[i] != left[j]) and ok(sets[i], sets[j]):
                        want.join(i, j)
            assert [found.find(i) for i in range(12)] == [want.find(i) for i in range(12)]


def test_sketches_estimate_similarity_and_fill():
    dice = np.random.default_rng(1)
    common, a, b = (mix(dice.integers(1, 2**62, n).astype(np.uint64)) for n in (800, 100, 100))
    rows = sketch.sketches([np.concatenate((common, a)), np.concatenate((common, b)), common[:1], common[:3], np.zeros(0, np.uint64)], 256)
    assert abs((rows[0] == rows[1]).mean() - 0.8) < 0.1
    assert not (rows[:4] == np.uint64(2**64 - 1)).any() and (rows[4] == np.uint64(2**64 - 1)).all()
    assert len(set(rows[2] & np.uint64(0xFFFFFFFF))) > 1


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    for k in (2, 5):
        rows = near_dup.near_duplicates(odd_docs, words=k).collect()
        assert len(rows) == odd_docs.count()
        by = {r.doc_id: r for r in rows}
        assert (by[0].n_shingles, by[0].component_id, by[0].kept) == (0, 0, True) and by[1].kept and by[2].n_shingles == 0
        assert by[3].component_id == by[4].component_id == by[5].component_id == 3 and not by[4].kept
        assert by[6].component_id == by[-5].component_id == -5
        assert by[9].component_id == 8
        assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dup.near_duplicates(no_docs).count() == 0
