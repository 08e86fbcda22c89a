"""Registered queries: the library's operators over the synthetic tables, each with SQL that says the same.

The tables hold no reports, so these are structural analogues: events stand for requests and attempts, lineitem for
an edge list, part names for model names, conversations for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import errors, keys, media, text, urls
from ..operators import failover, graph, keyreport, lookups, quota, ranking, retention, transcript
from ..streaming import sse
from . import records
from .records import model_names as _models
from .tables import table as _t

NOW = "2024-01-30 12:00:00"
#: A caller or source may hold a third of all rows: a day is counted in so many parts, a history summed in slices of so many ids.
SALTS, SLICE = 16, 100_000
PRIORITIES = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH"]


def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    seen = quota.admit(events, "user_id", "ts", ["event_id"], cap=3, salts=SALTS)
    return seen.select("event_id", "user_id", F.col("day").cast("string").alias("day"), "allowed", "used", "remaining", "percent")


def quota_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = quota.daily_usage(_t(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", cap=3)
    day = F.col("day")
    return used.select("user_id", day.cast("string").alias("day"), quota.slot_key(F.col("user_id").cast("string"), day).alias("slot"), quota.reset_at(day).cast("string").alias("reset"), "requests", "used", "remaining", "refused", "percent")


def edge_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"))
    nodes = _t(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return graph.prune_edges(edges, nodes)


def enum_order_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.withColumn("position", ranking.order_position(F.col("o_orderpriority"), PRIORITIES)).orderBy("position", "o_orderkey")


def rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_models(_models(spark, sf_dir), within=["p_brand"]).select("p_brand", "model", "score", "rank")


def anti_untried(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = _models(spark, sf_dir)
    sold = _t(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    ranked = ranking.rank_models(models.select("p_brand", "model").distinct(), within=["p_brand"])
    return ranking.next_untried(ranked, models.join(sold, "p_partkey", "left_semi"), within=["p_brand"])


def failover_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    kind = F.col("event_type")
    log = _t(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts", "event_id", "value", "event_type")
    log = log.select("user_id", "day", F.row_number().over(chain).alias("pos"), kind.isin("purchase", "signup").alias("ok"), ((kind != "error") | (F.col("value") < 50)).alias("retryable"), F.concat(kind, F.lit(":"), F.col("event_id").cast("string")).alias("error"))
    return failover.resolve(log, ["user_id", "day"], budget=5).withColumn("stopped_at", F.coalesce("stopped_at", F.lit(0)))


def fingerprint_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyreport.fingerprints(_t(spark, sf_dir, "documents").select("source", "text"), "text", ["source"])
    return found.where("duplicate").select("source", "fp", "n")


def pool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyreport.pool_report(_t(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_nationkey").cast("string").alias("key")), "key", ["c_mktsegment"]).withColumnsRenamed({"count": "n_keys", "distinct": "n_distinct", "duplicates": "n_duplicates"})


def newest_n_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return retention.newest(events, "ts", ["event_id"], within=["event_type"]).select("event_id", "event_type")


def newest_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.newest(_t(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", ["event_id"]).select("event_id", "user_id")


def byte_budget_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.lit(150).alias("base"))
    return retention.byte_budget(docs, ["source"], "doc_id", [], "base", "n_chars", 60_000, slices=F.floor(F.col("doc_id") / SLICE)).select("doc_id", "keep_entry", "keep_extra")


def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * 700).alias("label"), text.human_bytes(F.col("n_chars")).alias("small_label"))


def truncate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.truncate_label(F.col("text"), 60).alias("label"))


def wrap_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.wrap_label(F.col("text")), "\n").alias("label"))


def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.remove_invisible(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n_clean"), F.md5(clean.cast("binary")).alias("clean_md5"))


def url_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", text.strip_slashes(F.col("url")).alias("url"))


def strip_query_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", urls.drop_parameter(F.col("url"), "utm_source").alias("url"))


def url_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("/groq/models")).when(F.pmod("page_id", F.lit(3)) == 1, F.lit("/models")).otherwise(F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1))
    routed = _t(spark, sf_dir, "pages").select("page_id", urls.route_upstream(path).alias("r"))
    return routed.select("page_id", "r.vendor", "r.path", urls.allowed_path(F.col("r.vendor"), F.col("r.path")).alias("allowed"))


def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" \n<think>first "), F.col("role"), F.lit("</think>\n\n"), F.col("text"), F.lit(" <think>so </think> end"), F.when(F.col("turn") % 2 == 1, F.lit("<think>cut")).otherwise(F.lit("")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip_thinking(said).alias("answer"))


def sse_frame_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a stream of events in both line endings, cut into chunks by turn, and decoded."""
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct("text", F.lit(False).alias("thought")), F.struct(F.lit("hidden").alias("text"), F.lit(True).alias("thought"))).alias("parts")).alias("content"))).alias("candidates")))
    end = F.when(F.col("turn") % 2 == 0, F.lit("\r\n\r\n")).otherwise(F.lit("\n\n"))
    chunks = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("data: "), event, end).alias("chunk"))
    return sse.decode_chunks(chunks, "conv_id", "turn", "chunk", "a").select("conv_id", "text")


def role_map_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _t(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")))
    return transcript.transcripts(said, "conv_id", "turn", "role", "text")


def stopped_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _t(spark, sf_dir, "conversations").withColumn("stopped", F.col("conv_id") % 3 == 0)
    said = said.withColumn("text", F.when(F.col("conv_id") % 6 == 0, F.lit("")).otherwise(F.col("text")))
    return transcript.mark_stopped(said, "conv_id", "turn", "text", "stopped", "role").select("conv_id", "turn", "text")


def normalize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return _t(spark, sf_dir, "events").select("event_id", text.number_or(F.get_json_object(props, "$.k")).alias("k"), errors.vendor_message(props).alias("message"))


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, [400, 401, 403, 404, 413, 429, 500, 418])), (F.col("user_id") % 8 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ["API key not valid", "Model x is not supported", "has not been used in project", "referer blocked", "quota", "vision"])), (F.col("event_id") % 6 + 1).cast("int"))
    body = F.when(F.col("event_type") == "view", F.lit("no json, vision")).otherwise(F.concat(F.lit('{"error":{"message":"'), said, F.lit('"}}')))
    vendor = F.when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    return _t(spark, sf_dir, "events").select("event_id", errors.classify_error(vendor, status, body).alias("class"), errors.retryable(vendor, status, body).alias("retryable"), errors.key_exhausted(status, body).alias("key_exhausted"))


def key_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.sha2(F.col("c_name"), 256)
    raw = F.when(F.col("c_custkey") % 6 == 0, F.concat(F.lit("AIza"), F.substring(digits, 1, 35))).when(F.col("c_custkey") % 6 == 1, F.concat(F.lit("AIza"), F.substring(digits, 1, 20)))
    raw = raw.when(F.col("c_custkey") % 6 == 2, F.concat(F.lit("gsk_"), digits)).when(F.col("c_custkey") % 6 == 3, F.concat(F.lit("gsk_"), digits, F.lit("​\n"))).when(F.col("c_custkey") % 6 == 4, F.lit("")).otherwise(digits)
    vendor = F.when(F.col("c_nationkey") % 2 == 0, "a").otherwise("b")
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.diagnose_key(vendor, raw).alias("d")).select("c_custkey", "d.level", "d.code", F.coalesce("d.length", F.lit(0)).cast("long").alias("length"))


def ordered_contains_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ["", "Infrared", "infra", "AMBER", "blue-green"])), (F.col("p_partkey") % 5 + 1).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.colour_of(word).alias("colour"))


def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.first_seen(_t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), "event_type", ["ts", "event_id"], within=["user_id"])
    return found.select("user_id", "event_type", F.col("first.event_id").alias("first_event_id"))


def coalesce_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, F.lit("")).otherwise(F.col("o_orderpriority"))
    b = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.col("o_orderstatus"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.first_text(a, b, "Schematic").alias("title"), text.first_value(a, b, "Part").alias("part"), text.join_present(" · ", a, b).alias("line"), text.empty_to_null(b).alias("hint"))


def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", text.relative_date(F.col("ts"), F.lit(NOW).cast("timestamp")).alias("label"))


def image_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, n = F.col("p_size") * 150, F.floor(F.col("p_retailprice") * 4).cast("long"), F.col("p_partkey") * 50_000
    sized = _t(spark, sf_dir, "part").select("p_partkey", media.image_size(w, h).alias("i"), media.page_size(w, h, media.PREVIEW_EDGE).alias("p"), n.alias("n"))
    return sized.select("p_partkey", F.col("i.width").alias("width"), F.col("i.height").alias("height"), F.col("p.width").alias("preview_width"), F.col("p.height").alias("preview_height"), media.passes_unchanged(F.col("i.scale"), F.col("n"), F.lit("image/png")).alias("unchanged"), media.page_batch(F.col("p_partkey") + 1).alias("batch"))


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _t(spark, sf_dir, "region").where("r_regionkey < 3")
    return lookups.lookup(_t(spark, sf_dir, "nation"), regions, "n_regionkey", "r_regionkey", "r_name", "Elsewhere").select("n_nationkey", "r_name", lookups.dictionary(F.col("n_regionkey").cast("string"), {"0": "zero", "1": "one"}, "other").alias("word"))


def transcript_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("chat"))
    changes = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("chat"))
    return retention.replace_value(rows, changes, "c_custkey", "chat")


QUERIES = {q.__name__: q for q in (
    quota_admission, quota_daily_usage, edge_prune, enum_order_top, rank_score, anti_untried, failover_first_success, fingerprint_duplicates, pool_report,
    newest_n_per_source, newest_overall, byte_budget_retention, human_bytes, truncate_labels, wrap_labels, sanitize_text, url_clean, strip_query_param,
    url_routing, think_strip, sse_frame_decode, role_map_transcript, stopped_transcripts, normalize_json, classify_errors, key_diagnosis,
    ordered_contains_class, distinct_first_seen, coalesce_title, relative_dates, image_geometry, lookup_default, transcript_replace,
)}

_S = text.SPACES
_RANKED = f"{records.MODELS}, scored AS (SELECT p_partkey, p_brand, model, CAST({records.POINTS} AS DOUBLE) AS score FROM models)"

ORACLE_SQL = {
    "quota_admission": """
WITH n AS (SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, user_id, day, rn <= 3 AS allowed, least(rn, 3) AS used, 3 - least(rn, 3) AS remaining, CAST(least(100, floor(least(rn, 3) * 100 / 3.0 + 0.5)) AS BIGINT) AS percent FROM n""",
    "quota_daily_usage": """
WITH n AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS requests FROM events GROUP BY ALL)
SELECT user_id, CAST(d AS VARCHAR) AS day, 'rl:' || CAST(d AS VARCHAR) || ':' || user_id AS slot, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS reset,
       requests, least(requests, 3) AS used, 3 - least(requests, 3) AS remaining, requests - least(requests, 3) AS refused,
       CAST(least(100, floor(least(requests, 3) * 100 / 3.0 + 0.5)) AS BIGINT) AS percent FROM n""",
    "edge_prune": """
WITH ids AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25)
SELECT l_orderkey, l_linenumber, l_partkey AS "from", l_suppkey AS "to" FROM lineitem
WHERE l_partkey IN (SELECT id FROM ids) AND l_suppkey IN (SELECT id FROM ids) AND l_partkey <> l_suppkey""",
    "enum_order_top": f"""
SELECT o_orderkey, o_orderpriority, CAST(coalesce(list_position({PRIORITIES}, o_orderpriority), 0) AS BIGINT) AS position FROM orders""",
    "rank_score": f"""
WITH {_RANKED} SELECT p_brand, model, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, model) AS INTEGER) AS rank FROM scored WHERE score > -100""",
    "anti_untried": f"""
WITH {_RANKED}, tried AS (SELECT DISTINCT p_brand, model FROM scored WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)),
untried AS (SELECT DISTINCT p_brand, model, score FROM scored s WHERE score > -100 AND NOT EXISTS (SELECT 1 FROM tried t WHERE t.p_brand = s.p_brand AND t.model = s.model)),
n AS (SELECT p_brand, model, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, model) AS rn FROM untried)
SELECT p_brand, model FROM n WHERE rn = 1""",
    "failover_first_success": """
WITH a AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS pos,
                  event_type IN ('purchase', 'signup') AS ok, event_type <> 'error' OR value < 50 AS retryable, event_type || ':' || event_id AS error FROM events),
b AS (SELECT * FROM a WHERE pos <= 5),
s AS (SELECT user_id, day, min(pos) FILTER (WHERE ok OR NOT retryable) AS stop, count(*) AS n FROM b GROUP BY ALL)
SELECT s.user_id, s.day, CASE WHEN e.ok THEN 'success' WHEN stop IS NULL THEN 'exhausted' ELSE 'fatal' END AS outcome, CAST(coalesce(stop, 0) AS INTEGER) AS stopped_at,
       CAST(coalesce(stop, n) AS BIGINT) AS attempts, CASE WHEN e.ok THEN NULL ELSE e.error END AS error
FROM s JOIN b e ON e.user_id = s.user_id AND e.day = s.day AND e.pos = coalesce(stop, n)""",
    "fingerprint_duplicates": "SELECT source, left(sha256(text), 8) AS fp, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1",
    "pool_report": """
WITH f AS (SELECT c_mktsegment, left(sha256(CAST(c_nationkey AS VARCHAR)), 8) AS fp, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n_keys, count(*) AS n_distinct, count(*) FILTER (WHERE n > 1) AS n_duplicates FROM f GROUP BY ALL""",
    "newest_n_per_source": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 25",
    "newest_overall": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25",
    "byte_budget_retention": """
WITH w AS (SELECT doc_id, n_chars, sum(150) OVER (PARTITION BY source) AS base, sum(150) OVER o AS base_so_far, sum(n_chars) OVER o AS extra
           FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING))
SELECT doc_id, base <= 60000 OR base_so_far <= 60000 AS keep_entry, base <= 60000 AND base + extra <= 60000 AND n_chars > 0 AS keep_extra FROM w""",
    "human_bytes": """
WITH s AS (SELECT doc_id, n_chars * 700 AS big, n_chars AS small FROM documents)
SELECT doc_id, CASE WHEN big < 1024 THEN big || ' B' WHEN big < 1048576 THEN CAST(floor(big / 1024.0 + 0.5) AS BIGINT) || ' KB'
    ELSE CAST(floor(floor(CAST(big AS DOUBLE) / 1048576 * 10 + 0.5) / 10) AS BIGINT) || '.' || CAST(floor(CAST(big AS DOUBLE) / 1048576 * 10 + 0.5) AS BIGINT) % 10 || ' MB' END AS label,
  CASE WHEN small < 1024 THEN small || ' B' ELSE CAST(floor(small / 1024.0 + 0.5) AS BIGINT) || ' KB' END AS small_label FROM s""",
    "wrap_labels": rf"""
WITH w AS (SELECT doc_id, text, [{{'lines': []::VARCHAR[], 'line': x, 'full': FALSE}} for x in regexp_split_to_array(text, '[{_S}]+')] AS words FROM documents),
f AS (SELECT doc_id, text, list_reduce(words, lambda a, x: CASE WHEN a['full'] THEN a
    WHEN length(CASE WHEN a['line'] = '' THEN x['line'] ELSE a['line'] || ' ' || x['line'] END) <= 19 THEN {{'lines': a['lines'], 'line': CASE WHEN a['line'] = '' THEN x['line'] ELSE a['line'] || ' ' || x['line'] END, 'full': FALSE}}
    ELSE {{'lines': CASE WHEN a['line'] = '' THEN a['lines'] ELSE list_append(a['lines'], a['line']) END, 'line': x['line'], 'full': len(CASE WHEN a['line'] = '' THEN a['lines'] ELSE list_append(a['lines'], a['line']) END) >= 2}} END,
    {{'lines': []::VARCHAR[], 'line': '', 'full': FALSE}}) AS a FROM w),
l AS (SELECT doc_id, text, CASE WHEN a['line'] <> '' AND len(a['lines']) < 2 THEN list_append(a['lines'], a['line']) ELSE a['lines'] END AS lines FROM f)
SELECT doc_id, array_to_string(CASE WHEN len(lines) > 0 AND length(array_to_string(lines, ' ')) < length(text) THEN list_append(lines[:-2], regexp_replace(substr(lines[-1], 1, 18), '[{_S}]+\z', '') || '…') ELSE lines END, chr(10)) AS label FROM l""",
    "truncate_labels": rf"SELECT doc_id, CASE WHEN length(text) > 60 THEN regexp_replace(substr(text, 1, 59), '[{_S}]+\z', '') || '…' ELSE text END AS label FROM documents",
    "sanitize_text": rf"WITH c AS (SELECT doc_id, regexp_replace(text, '[{_S}{text.ZERO_WIDTH}]', '', 'g') AS clean FROM documents) SELECT doc_id, length(clean) AS n_clean, md5(clean) AS clean_md5 FROM c",
    "url_clean": r"SELECT page_id, regexp_replace(trim(url), '/+$', '') AS url FROM pages",
    "strip_query_param": r"""
SELECT page_id, CASE WHEN regexp_matches(url, '[?&]utm_source=') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])utm_source=[^&#]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&](#|$)', '\1', 'g') ELSE url END AS url FROM pages""",
    "url_routing": r"""
WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/groq/models' WHEN 1 THEN '/models' ELSE regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) END AS path FROM pages),
r AS (SELECT page_id, CASE WHEN path = '/groq' OR path LIKE '/groq/%' THEN 'b' ELSE 'a' END AS vendor, CASE WHEN path LIKE '/groq/%' THEN substr(path, 6) WHEN path = '/groq' THEN '/' ELSE path END AS path FROM p)
SELECT page_id, vendor, path, CASE WHEN vendor = 'b' THEN path IN ('/models', '/chat/completions') ELSE path = '/models' OR regexp_matches(path, '^/models/[A-Za-z0-9._-]+:(generateContent|streamGenerateContent)$') END AS allowed FROM r""",
    "think_strip": r"SELECT conv_id, turn, trim(regexp_replace(text || ' end', '\A[\t\n\v\f\r ]+', '')) AS answer FROM conversations",
    "sse_frame_decode": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "role_map_transcript": r"SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript, count(*) AS messages FROM conversations GROUP BY conv_id",
    "stopped_transcripts": """
WITH c AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 6 = 0 THEN '' ELSE text END AS text, conv_id % 3 = 0 AS stopped, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
l AS (SELECT conv_id, role = 'assistant' AS answered, text = '' AS empty, role = 'user' AS asked FROM c WHERE back = 1)
SELECT conv_id, turn, CASE WHEN stopped AND back = 1 AND answered THEN text || chr(10) || chr(10) || '[stopped]' ELSE text END AS text FROM c JOIN l USING (conv_id)
WHERE NOT (stopped AND (back = 1 AND (asked OR answered AND empty) OR back = 2 AND answered AND empty AND role = 'user'))""",
    "normalize_json": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, coalesce(json_extract_string(props, '$.error.message'), '') AS message FROM events",
    "classify_errors": """
WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS vendor, [400, 401, 403, 404, 413, 429, 500, 418][user_id % 8 + 1] AS status,
    CASE WHEN event_type = 'view' THEN '' ELSE ['API key not valid', 'Model x is not supported', 'has not been used in project', 'referer blocked', 'quota', 'vision'][event_id % 6 + 1] END AS said, event_type = 'view' AS plain FROM events)
SELECT event_id, CASE WHEN vendor = 'a' THEN CASE WHEN said LIKE '%is not supported' THEN 'model-gone' WHEN status = 400 AND said = 'API key not valid' THEN 'bad-key' WHEN status = 403 AND said LIKE 'has not%' THEN 'api-disabled'
      WHEN status = 403 AND said LIKE 'referer%' THEN 'key-restricted' WHEN status = 403 THEN 'denied' WHEN status = 413 THEN 'too-large' WHEN status = 429 THEN 'rate-limited' WHEN status = 404 THEN 'model-gone' WHEN status >= 500 THEN 'server-error' ELSE 'failed' END
    ELSE CASE WHEN status = 401 THEN 'bad-key' WHEN status = 404 THEN 'model-gone' WHEN plain OR said = 'vision' THEN 'no-images' WHEN status = 413 THEN 'too-large' WHEN status = 429 THEN 'rate-limited' WHEN status >= 500 THEN 'server-error' ELSE 'failed' END END AS class,
  status IN (404, 429) OR status >= 500 OR CASE WHEN vendor = 'b' THEN plain OR said = 'vision' ELSE said LIKE '%is not supported' END AS retryable,
  status = 429 OR (status = 403 AND (said LIKE 'has not%' OR said = 'quota')) OR (status = 400 AND said = 'API key not valid') AS key_exhausted FROM s""",
    "key_diagnosis": r"""
WITH k AS (SELECT c_custkey, c_nationkey % 2 = 0 AS a, c_custkey % 6 AS m FROM customer),
d AS (SELECT c_custkey, CASE WHEN m = 4 THEN NULL WHEN m = 3 THEN 'cleaned' WHEN a THEN ['well-formed', 'truncated', 'unknown-format', '', '', 'unknown-format'][m + 1] ELSE ['wrong-prefix', 'wrong-prefix', 'well-formed', '', '', 'wrong-prefix'][m + 1] END AS code, [39, 24, 68, 68, 0, 64][m + 1] AS n FROM k)
SELECT c_custkey, CASE code WHEN 'cleaned' THEN 'warn' WHEN 'unknown-format' THEN 'warn' WHEN 'well-formed' THEN 'ok' WHEN NULL THEN NULL ELSE CASE WHEN code IS NULL THEN NULL ELSE 'error' END END AS level, code, CAST(CASE WHEN code IS NOT NULL THEN n ELSE 0 END AS BIGINT) AS length FROM d""",
    "ordered_contains_class": """
WITH w AS (SELECT p_partkey, lower(p_name || ' ' || ['', 'Infrared', 'infra', 'AMBER', 'blue-green'][p_partkey % 5 + 1]) AS c FROM part)
SELECT p_partkey, CASE WHEN contains(c, 'green') THEN '#57cc99' WHEN contains(c, 'red') THEN '#ff6b6b' WHEN contains(c, 'amber') OR contains(c, 'yellow') OR contains(c, 'orange') THEN '#f9c74f'
  WHEN contains(c, 'blue') THEN '#4cc9f0' WHEN contains(c, 'white') THEN '#e8eef5' WHEN contains(c, 'infra') THEN '#6b4bd6' ELSE '#8ea0b5' END AS colour FROM w""",
    "distinct_first_seen": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event_id FROM events GROUP BY ALL",
    "coalesce_title": """
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS b FROM orders)
SELECT o_orderkey, coalesce(nullif(a, ''), nullif(b, ''), 'Schematic') AS title, coalesce(a, b, 'Part') AS part, concat_ws(' · ', nullif(a, ''), nullif(b, '')) AS line, nullif(b, '') AS hint FROM v""",
    "relative_dates": f"""
WITH e AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, DATE '{NOW[:10]}' AS today FROM events)
SELECT event_id, CASE WHEN d = today THEN 'Today' WHEN d = today - 1 THEN 'Yesterday' WHEN year(d) = year(today) THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%b %-d, %Y') END || ', ' || strftime(ts, '%-I:%M %p') AS label FROM e""",
    "image_geometry": """
WITH s AS (SELECT p_partkey, CAST(p_size * 150 AS DOUBLE) AS w, floor(p_retailprice * 4) AS h, p_partkey * 50000 AS n FROM part),
k AS (SELECT *, least(1.0, 3072.0::DOUBLE / greatest(w, h)) AS scale, 260.0::DOUBLE / greatest(w, h) AS small FROM s)
SELECT p_partkey, CAST(floor(w * scale + 0.5) AS BIGINT) AS width, CAST(floor(h * scale + 0.5) AS BIGINT) AS height, CAST(greatest(1, floor(w * small + 0.5)) AS BIGINT) AS preview_width,
  CAST(greatest(1, floor(h * small + 0.5)) AS BIGINT) AS preview_height, scale = 1 AND n <= 6 * 1024 * 1024 AS unchanged, p_partkey // 24 AS batch FROM k""",
    "lookup_default": """
SELECT n_nationkey, coalesce(r_name, 'Elsewhere') AS r_name, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS word
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey""",
    "transcript_replace": "SELECT c_custkey, coalesce((SELECT max(o_orderstatus) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS chat FROM customer",
}

QUERIES |= records.QUERIES
ORACLE_SQL |= records.ORACLE_SQL
