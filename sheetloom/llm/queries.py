"""The registered queries of this subpackage, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, licenses, media, near_dup, packing, ppm, quality, rollup, search, sharding, sql, token_orc, warc
from .storage import materialize, new_path, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "tokens")
    token_orc.write_tokens(_table(spark, sf_dir, "documents"), path)
    tokens = token_orc.read_tokens(spark, path)
    return token_orc.with_global_start(token_orc.digests(tokens), tokens).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_differencing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80).drop("text_mark", "first")


def op9_positional_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    hits = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), words=10)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "media")
    stored = media.store_as_tiff(_table(spark, sf_dir, "documents"))
    stored.write.option("compression", "none").parquet(path)  # the images are compressed already
    paged = media.tiff_pages(spark.read.schema(media.STORED).parquet(path))
    told = media.page_features(paged)
    sound = F.when(F.col("error").isNull(), F.col("feature")).otherwise(F.raise_error("error"))  # what was just stored must come back
    return told.withColumn("feature", sound).drop("page", "error")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "warc")
    warc.write_records(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


#: Documents for each part of the ledger.
ROWS_A_PART = 500_000


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over the whole table: every document is put under two tokenizer versions; those labelled toxic are deleted; those labelled bad are counted anew. The second batch is sent twice, and a snapshot is made after it, which the third starts from."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counts = docs.select("doc_id", "source", "lang", rollup.spaced_words("text").alias("words"), size.alias("bytes"), rollup.plain_words("text").alias("plain"))
    counts = materialize(counts, "counts")  # texts are read once and never shuffled
    store = rollup.RollupStore(spark, new_path(spark, "rollup"), parts=max(8, counts.count() // ROWS_A_PART))
    keep = ["doc_id", "source", "lang"]
    both = F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("n_tokens")), F.struct(F.lit("bytes-1").alias("tokenizer"), F.col("bytes").alias("n_tokens"))))
    store.commit(1, counts.select(*keep, both.alias("c")).select(*keep, "c.*", F.lit("put").alias("op")))
    toxic = counts.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    gone = toxic.select(*keep, F.explode(F.array(F.lit("words-1"), F.lit("bytes-1"))).alias("tokenizer"), F.lit(None).cast("long").alias("n_tokens"), F.lit("delete").alias("op"))
    store.commit(2, gone)
    store.commit(2, gone)
    store.compact()
    bad = counts.join(labels.where("quality = 0 AND toxic = 0"), "doc_id", "left_semi")
    store.commit(3, bad.select(*keep, F.lit("words-1").alias("tokenizer"), F.col("plain").alias("n_tokens"), F.lit("put").alias("op")))
    return store.totals().select("source", "lang", "tokenizer", "docs", "tokens")


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents")).drop("statements")


def op11_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    model = ppm.fit(docs.where(~ppm.held_out(F.col("doc_id"))))
    told = ppm.score(docs, model)
    return told.select("doc_id", ppm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return alignment.alignment(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    "op1_token_orc": op1_token_orc,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_token_rollup": op3_token_rollup,
    "op4_warc_chunks": op4_warc_chunks,
    "op5_compression_quality": op5_compression_quality,
    "op6_differencing_windows": op6_differencing_windows,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_tiff_media": op8_tiff_media,
    "op9_positional_hits": op9_positional_hits,
    "op10_license_sentences": op10_license_sentences,
    "op11_byte_ppm": op11_byte_ppm,
    "op12_token_alignment": op12_token_alignment,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    # Rows that repeat a doc_id are one document: the one with the greatest count, then source, then language. Rows without doc_id count each.
    "op3_token_rollup": r"""
WITH live AS (
  SELECT source, lang, text, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0 AND doc_id IS NOT NULL), FALSE) AS bad
  FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
counted AS (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer,
         len(regexp_extract_all(coalesce(text, ''), CASE WHEN bad THEN '[A-Za-z0-9]+' ELSE '[^\x20\x09-\x0D]+' END)) AS n
  FROM live
  UNION ALL SELECT doc_id, source, lang, 'bytes-1', octet_length(encode(coalesce(text, ''))) FROM live),
one AS (
  SELECT * FROM counted
  QUALIFY doc_id IS NULL OR row_number() OVER (PARTITION BY doc_id, tokenizer ORDER BY n DESC, coalesce(source, '') DESC, coalesce(lang, '') DESC) = 1)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS tokens
FROM one GROUP BY source, lang, tokenizer""",
    "op4_warc_chunks": sql.WARC_RECORDS,
    "op7_near_duplicates": sql.NEAR_DUPLICATES,
    "op9_positional_hits": sql.BENCHMARK_HITS,
    "op10_license_sentences": licenses.license_sql(),
    "op13_ranked_search": sql.RANKED_SEARCH,
}
