import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheetloom.llm import bpe, queries, token_orc
from sheetloom.llm.storage import new_path


def whole(texts, end):
    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # the library as it is
    return [np.array([*(code.encode(t, add_special_tokens=False).ids if t else []), end], dtype="<u4").tobytes() for t in texts]


def test_stretches_give_the_librarys_ids():
    parts = [" ", "  ", "\n", " \n", "a", "the", "'s", "é", "ß", "1", "²", "!", "\t", "　", "\xa0", "\x85", "<|endoftext|>", "'ll", "\r\n", "日本", "😀", "\x1c", "_", "Ā", "x" * 70]
    dice = random.Random(1)
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 12))) for _ in range(20_000)]
    assert bpe.Encoder(bpe.default_vocabulary()).encode(texts, 2) == whole(texts, 2)


def test_names_of_added_tokens_give_their_ids():
    name = "<|endoftext|>"
    texts = [name, f"{name} then text", f"text {name} text", f"text {name}", f"a{name}b", name * 3, f"x  {name}", "<|endoftext |>", "<|endoftext|", f"hello {name} world"]
    got = bpe.Encoder(bpe.default_vocabulary()).encode(texts, 2)
    assert got == whole(texts, 2)
    assert np.frombuffer(got[-1], "<u4").tolist() == [31373, 220, 50256, 995, 2]


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = ["the quick brown fox jumps over the lazy dog, twice", "the the quick!", "", None]
    assert bpe.Encoder(bpe.default_vocabulary()).encode(texts, 2) == whole(texts, 2)


def check(rows, docs):
    """Ascending ids, each row's start being the number of ids before it; rows of one doc_id in any order."""
    want = Counter((doc_id, len(ids) // 4, zlib.crc32(ids)) for (doc_id, _), ids in zip(docs, whole([t for _, t in docs], 2), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))


def test_a_frequent_id_or_row_fills_no_file(spark):
    rows = [(7, "hot row")] * 4000 + [(None, f"null {i}") for i in range(4000)] + [(i, f"text {i}") for i in range(4000)]
    path = new_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one file
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tokens = token_orc.read_tokens(spark, path)
    sizes = [r["count"] for r in tokens.groupBy("part").count().collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 6000
    check(token_orc.with_global_start(token_orc.digests(tokens), tokens).collect(), rows)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(queries.op1_token_orc(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    path = new_path(spark, "t")
    token_orc.write_tokens(odd_docs, path)
    tokens = token_orc.read_tokens(spark, path)
    rows = token_orc.with_global_start(token_orc.digests(tokens), tokens).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    check(rows, [(r[0], r[1]) for r in odd_rows])
    assert [len(r.ids) for r in token_orc.find_documents(spark, path, [3]).collect()] == [2]
    path = new_path(spark, "t")
    token_orc.write_tokens(no_docs, path)
    tokens = token_orc.read_tokens(spark, path)
    assert token_orc.with_global_start(token_orc.digests(tokens), tokens).count() == 0


def test_filters_reach_the_orc_scan(spark, sf_dir):
    path = new_path(spark, "t")
    token_orc.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    plan = token_orc.find_documents(spark, path, [3]).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,3)" in plan or "In(doc_id" in plan
    assert token_orc.read_tokens(spark, path).agg(F.sum("n_tokens")).first()[0] > 0
