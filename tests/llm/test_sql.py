"""The registered SQL against the queries, on the smallest tables and on odd rows."""

import duckdb
import pytest

from sheetloom.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")


def same(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    found, want = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr([r[c] for c in columns]) for r in found.collect())
    assert got and got == sorted(repr([r[i] for i in at]) for r in want.fetchall())
    return got


@pytest.mark.parametrize("name", ["op4_warc_chunks", "op7_near_duplicates", "op9_positional_hits", "op13_ranked_search"])
def test_smallest_tables(spark, sf_dir, name):
    same(spark, name, sf_dir)


@pytest.fixture(scope="module")
def folder(spark, odd_rows, odd_docs, tmp_path_factory):
    """Tables of odd rows: links of 80 % and just less, chains, payloads that repeat, items shorter than a window."""
    path = str(tmp_path_factory.mktemp("odd"))
    run = [f"k{i}" for i in range(101)]
    chain = [" ".join(run[a : a + 91]) for a in range(0, 11, 5)] + [" ".join(run[:90]), " ".join(run[11:101]), " ".join(reversed(run))]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = [(1000 + i, t, "en", "s", None) for i, t in enumerate(chain * 2)] + [(None, chain[0], None, None, None), (None, "only here without id", None, None, None), (2000, "say One-Two three four and one two three, FOUR", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{path}/documents.parquet")
    pages = [(i, f"u{i}", r[1]) for i, r in enumerate(odd_rows)] + [(None, None, ""), (None, "u", "one"), (3, "u", "one"), (-1, "v", "é"), (99, "v", "é"), (98, "v", None), (97, "v", "only here")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    items = [(1, " ".join(run[:25])), (2, "one two three four"), (3, "one two three four"), (4, ""), (5, None), (None, "ONE"), (6, " ".join(run[40:50])), (7, "one two three four five six seven eight nine ten eleven"), (8, "..."), (10, "w5 x5 w6 x6 w7"), (6, " ".join(run[60:71]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("name", ["op4_warc_chunks", "op7_near_duplicates", "op9_positional_hits", "op13_ranked_search"])
def test_odd_rows(spark, folder, name):
    assert len(set(same(spark, name, folder))) > 10
