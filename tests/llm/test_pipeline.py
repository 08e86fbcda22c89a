import pytest

import corpus_pipeline
from sheetloom.llm import quality

from .test_op6_packing import check
from .test_op7_near_dup import brute as near
from .test_op9_decontaminate import brute as hits


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = model.scorer()
    kept = [i for i, r in rows.items() if scorer.scores([(r.text or "").encode()])[0] >= 0.7]
    first = near([(i, rows[i].text) for i in kept], 5)
    kept = [i for i in kept if first[i][1] == i]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = [i for i, *_, bad in hits([(i, rows[i].text) for i in kept], bench, 10) if not bad]
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    assert check(pieces, [(i, rows[i].text) for i in kept]) > 0.95


def test_stages_keep_and_drop_rows_not_ids(spark, odd_docs, odd_rows):
    """Odd rows against brute force: near-duplicates by equal texts here, benchmark passages by row; nulls, repeated ids and rows included."""
    sf = "/root/testdata/sf0.001"
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, item, 1), (1, "clean text", 2), (None, item, 3), (None, "also clean", 4), (2, "x " + item, 5), (2, "x " + item, 6), (3, None, 7), (4, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    left = corpus_pipeline.no_benchmark(spark, frame, sf)
    assert sorted(map(tuple, left.collect()), key=key) == sorted([rows[1], rows[3], rows[6], rows[7]], key=key)
    kept = corpus_pipeline.one_of_each(spark, odd_docs, sf).collect()
    near = {}  # the first row by (doc_id, text) of each text's shingles; texts without words are documents of their own
    for r in odd_rows:
        words = (r[1] or "").lower().split(" ") if r[0] not in (2, 10, 11, 12, 17) else []
        near.setdefault(" ".join(words) if any(words) else (r[0], r[1]), []).append(r)
    assert {(k.doc_id, k.text) for k in kept} <= {(r[0], r[1]) for r in odd_rows}
    assert len(kept) == len({(k.doc_id, k.text) for k in kept})
    for group, same in near.items():
        ids = [r[0] for r in same if r[0] is not None]
        if isinstance(group, str) and not group.startswith("w0") and group:
            assert [k.doc_id for k in kept if (k.text or "").lower() == group] == [min(ids) if ids else None], group


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
