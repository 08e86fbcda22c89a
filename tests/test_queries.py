import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from pyspark.sql import functions as F

from sheetloom.plans import queries, records

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    pick = lambda r, names: tuple(dict(zip(names, r, strict=True))[c] for c in columns)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = sorted((pick(r, found.columns) for r in found.collect()), key=key)
    assert got and got == sorted((pick(r, want.columns) for r in want.fetchall()), key=key)


def test_wrapped_labels_fit(spark, sf_dir):
    rows = queries.wrap_labels(spark, sf_dir).collect()
    assert rows and all(len(r.label.split("\n")) <= 2 for r in rows)


@pytest.mark.parametrize("name", ["_reports", "report_normalize", "exploded_edges"])
def test_reports_are_spread_over_tasks(spark, sf_dir, name):
    rows = getattr(records, name)(spark, sf_dir)
    assert rows.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())


def test_nothing_else_needs_the_training_data_operators(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("__spark_entry__.py", "bench.py"):
            (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    (tmp_path / "sheetloom").mkdir()
    for name in os.listdir(f"{ROOT}/sheetloom"):
        if name != "llm":
            os.symlink(f"{ROOT}/sheetloom/{name}", tmp_path / "sheetloom" / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('sheetloom.plans.queries', fromlist=['x']).QUERIES), 'pipeline' in e.queries())"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "False"], said.stderr
