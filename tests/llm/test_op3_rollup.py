import random
from collections import Counter

import duckdb
import pytest

from sheetloom.llm import queries, rollup
from sheetloom.llm.storage import new_path

CHANGES = "doc_id long, tokenizer string, source string, lang string, n_tokens long, op string, batch string"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op3_token_rollup"]).fetchall()
    assert sorted(map(tuple, queries.op3_token_rollup(spark, sf_dir).collect())) == sorted(want)


def test_random_batches_against_a_dictionary(spark):
    dice, live, store = random.Random(3), {}, rollup.RollupStore(spark, new_path(spark, "r"))
    for batch in range(1, 5):
        rows = []
        for key in dice.sample([(d, t) for d in range(12) for t in ("v1", "v2", None)], 14):
            if dice.random() < 0.3:
                rows.append((*key, None, None, None, "delete", "x"))
                live.pop(key, None)
            else:
                said = (dice.choice(["s", "t", None]), dice.choice(["en", None]), dice.choice([0, 3, 50]))
                rows.append((*key, *said, "put", "x"))
                live[key] = said
        changes = spark.createDataFrame(rows, CHANGES)
        assert store.commit(batch, changes)
        assert not store.commit(batch, changes)  # sent twice: nothing changes
        if batch == 2:
            store.compact()
            store.compact()
        docs, tokens = Counter(), Counter()
        for (_, t), (s, lang, n) in live.items():
            docs[s, lang, t] += 1
            tokens[s, lang, t] += n
        assert totals(store) == {k: (docs[k], tokens[k]) for k in docs}
    with pytest.raises(ValueError):
        store.commit(2.5, changes)


def test_a_commit_cut_short_is_done_again(spark, monkeypatch):
    store = rollup.RollupStore(spark, new_path(spark, "r"))
    changes = spark.createDataFrame([(1, "v", "s", "en", 5, "put", "")], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(store, "_mark", lambda b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(1, changes)
    assert totals(store) == {}
    assert store.commit(1, changes)
    assert totals(store) == {("s", "en", "v"): (1, 5)}


def test_odd_rows(spark):
    store = rollup.RollupStore(spark, new_path(spark, "r"))
    assert totals(store) == {}
    rows = [(None, "v", None, None, 2, "put", ""), (None, "v", None, None, 3, "put", ""), (None, "v", None, None, 3, "delete", ""), (1, "v", None, "en", None, "put", ""), (2, "v", "a", "en", 4, "put", ""), (2, "v", "a", "en", 9, "put", ""), (3, "v", "a", "en", 7, "put", ""), (3, "v", "a", "en", None, "delete", "")]
    store.commit(1, spark.createDataFrame(rows, CHANGES))
    assert totals(store) == {(None, None, "v"): (2, 5), (None, "en", "v"): (1, 0), ("a", "en", "v"): (1, 9)}
    store.commit(2, spark.createDataFrame([], CHANGES))
    assert len(totals(store)) == 3


def test_repeated_documents_against_sql(spark, tmp_path):
    rows = [(1, "a b c", "en", "s"), (1, "a", "de", "t"), (2, "x y!", "en", "s"), (2, "x y!", "en", "s"), (3, "bad one, two", "en", "s"), (3, "bad, b, c", "en", "u"), (4, "toxic", "en", "s"), (4, "more", "en", "s"), (None, "n n", None, None), (None, "n n", None, None), (5, None, "en", "s")]
    labels = [(3, 0, 0), (4, 1, 1), (9, 0, 1), (None, 0, 0), (None, 1, 1), (3, 0, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op3_token_rollup"]).fetchall()
    got = list(map(tuple, queries.op3_token_rollup(spark, str(tmp_path)).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_later_commits_read_nothing_before_the_snapshot(spark):
    store = rollup.RollupStore(spark, new_path(spark, "r"), parts=4)
    store.commit(1, spark.createDataFrame([(i, "v", "s", "en", i, "put", "") for i in range(20)], CHANGES))
    store.commit(2, spark.createDataFrame([(3, "v", "s", "en", None, "delete", "")], CHANGES))
    store.compact()
    assert store._ledger().count() == 19 and not any("/ledger/" in f for f in store._ledger().inputFiles())
    store.commit(3, spark.createDataFrame([(3, "v", "t", "en", 5, "put", ""), (4, "v", "s", "en", 7, "put", "")], CHANGES))
    assert totals(store) == {("s", "en", "v"): (19, sum(range(20)) - 3 + 3), ("t", "en", "v"): (1, 5)}
