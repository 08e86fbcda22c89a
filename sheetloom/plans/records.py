"""Registered queries over reports, histories, stored responses and settings, which are put together from the synthetic tables as JSON and text; each with SQL that says what must come out."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, media, text, urls
from ..operators import failover, keyreport, layout, quota, ranking, retention
from ..operators.transcript import joined_in_order
from ..sources import demo, files, images, reports, sinks
from ..sources.latest import LatestTable
from ..sources.pdf import PdfFiles, PdfPages
from ..sources.providers import provider
from ..streaming import quota as live
from ..streaming import sse
from ..streaming.runs import ROCKSDB, arrivals, drain
from .tables import scratch
from .tables import table as _t


def _pick(number: Column, *values: str | None) -> Column:
    """The value at a number's remainder; nulls stay."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each part, with lists missing, null and present, and edges of every kind."""
    k, s = F.col("p_partkey"), F.col("p_size")
    third = F.when(s % 3 == 0, F.lit('{"label":"no id"}')).otherwise(F.lit('{"id":"b2"}'))
    blocks = F.when(k % 6 == 0, F.lit("")).when(k % 6 == 1, F.lit('"blocks":null,')).otherwise(F.concat(F.lit('"blocks":[{"zz":{"deep":[1,null]},"id":"b0"},{"id":"b1"},'), third, F.lit("],")))
    last = F.concat(F.lit('{"from":"b'), (s % 3).cast("string"), F.lit('","to":"b1"}'))
    edges = F.concat(F.lit('"connections":[{"from":"b0","to":"b1","weight":0.5},{"from":"b0","to":"b0"},{"from":"b0","to":"zz"},{"from":"b1"},'), last, F.lit("],"))
    schematic = _pick(k, "", '"isSchematic":null,', '"isSchematic":false,', '"isSchematic":true,', '"isSchematic":true,')
    sheet = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('"sheet":{"title":"'), F.col("p_name"), F.lit('","extra":{"b":1,"a":"é"}},')))
    whole = F.concat(F.lit("{"), blocks, edges, schematic, sheet, F.lit('"notes":["n"],"other":1,"summary":"'), F.col("p_name"), F.lit('"}'))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a small file of parts would be one task, and its reports take long
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(width, "p_partkey")
    return parts.select("p_partkey", F.when(k % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("json"))


def report_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 with F2 inside the report, A5, K6, K9."""
    parsed = reports.parse_reports(_reports(spark, sf_dir))
    r = F.col("report")
    edges = F.array_join(F.transform(r["connections"], lambda c: F.concat(c["from"], F.lit(">"), F.coalesce(c["to"], F.lit("?")))), ",")
    return parsed.select(
        "p_partkey", "parsed", r["sheet"]["title"].alias("title"), r["sheet"]["circuitType"].alias("circuit"), r["isSchematic"].alias("schematic"), F.size(r["blocks"]).alias("blocks"),
        F.size(r["grounds"]).alias("grounds"), edges.alias("edges"), r["summary"].alias("summary"), r["confidence"].alias("confidence"), F.array_join(sinks.sections(r), ",").alias("sections"),
        sinks.compact_json(F.col("whole")).alias("exported"), F.get_json_object(sinks.pretty_json(F.col("whole")), "$.sheet.extra.a").alias("pretty_extra"),
    )


def exploded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, J1 over exploded tables: the edges of stored reports against their blocks."""
    k = F.col("p_partkey")
    stored = reports.parse_reports(_reports(spark, sf_dir).where(k % 11 != 0)).withColumnRenamed("p_partkey", "report_id")
    return reports.pruned_connections(reports.exploded(stored, "blocks"), reports.exploded(stored, "connections")).select("report_id", F.col("pos").cast("long").alias("pos"), "from", "to")


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in stored responses of both vendors, some of them broken or without a report."""
    k = F.col("c_custkey")
    report = F.to_json(F.struct(F.struct(F.col("c_name").alias("title")).alias("sheet")))
    said = F.when(k % 7 == 2, F.lit("no report")).otherwise(report)
    in_a = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    in_b = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit(" <think>so {} it is</think>\n"), said).alias("content")).alias("message"))).alias("choices")))
    broken = lambda body: F.when(k % 7 == 0, F.lit("oops")).when(k % 7 == 1, F.lit("{}")).otherwise(body)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", broken(in_a).alias("a"), broken(in_b).alias("b"))
    told = [provider(v).analyze(rows.where(F.col("c_nationkey") % 2 == i).select("c_custkey", F.col(v).alias("body"))) for i, v in enumerate("ab")]
    return told[0].unionByName(told[1]).select("c_custkey", "parsed", F.col("report.sheet.title").alias("title"))


def model_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models named by stored lists."""
    name, ways = F.concat(F.lit("models/m-"), F.col("p_partkey").cast("string")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"), F.lit("generateContent"))).otherwise(F.array(F.lit("embedContent")))
    in_a = F.to_json(F.struct(F.array(F.struct(name.alias("name"), ways.alias("supportedGenerationMethods"))).alias("models")))
    in_b = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("b-"), F.col("p_partkey").cast("string")).alias("id")), F.struct(F.lit(None).cast("string").alias("id"))).alias("data")))
    rows = _t(spark, sf_dir, "part").select(in_a.alias("a"), in_b.alias("b"))
    found = [provider(v).models(rows.select(F.col(v).alias("body"))).select(F.lit(v).alias("vendor"), "model") for v in "ab"]
    return found[0].unionByName(found[1])


def _vendor_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a part of vendor b's stream, with thinking, comments, broken events and the end mark."""
    event = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    before = F.when(F.col("turn") == 0, F.lit('data: {"choices":[{"delta":{"content":"<think>hid"}}]}\n\ndata: {"choices":[{"delta":{"content":"den</think>\\n"}}]}\n\n')).otherwise(F.lit(": note\r\n\r\ndata: {broken\n\n"))
    whole = F.concat(before, F.lit("data: "), event, F.when(F.col("turn") % 2 == 0, F.lit("\r\n\r\n")).otherwise(F.lit("\n\ndata: [DONE]\n\n")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", whole.alias("whole"))


def sse_vendor_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as vendor b's stream, cut into halves of events."""
    half = F.floor(F.length("whole") / 2).cast("int")
    cut = F.explode(F.array(F.struct((F.col("turn") * 2).alias("seq"), F.substring("whole", F.lit(1), half).alias("chunk")), F.struct((F.col("turn") * 2 + 1).alias("seq"), F.substring("whole", half + 1, F.length("whole")).alias("chunk"))))
    chunks = _vendor_b(spark, sf_dir).select("conv_id", cut.alias("c")).select("conv_id", "c.*")
    return sse.decode_chunks(chunks, "conv_id", "seq", "chunk", "b").select("conv_id", "text")


def _cut(streams: DataFrame) -> DataFrame:
    """The chunks (stream_id, seq, chunk, last) of ``streams`` (stream_id, whole, size), of ``size`` characters each. A stream is read once: a substring for each chunk would count its characters from the start every time."""
    pieces = streams.select("stream_id", F.regexp_extract_all("whole", F.concat(F.lit("(?s).{1,"), F.col("size").cast("string"), F.lit("}")), F.lit(0)).alias("pieces"))
    chunk = lambda c, i: F.struct(i.cast("long").alias("seq"), c.alias("chunk"), (i == F.size("pieces") - 1).alias("last"))
    return pieces.select("stream_id", F.inline(F.transform("pieces", chunk)))


#: Turns of conversations for which live_answers has a group of streams, and the least number of groups.
TURNS_A_GROUP, LEAST_GROUPS = 300, 64


def live_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams live. Their chunks, cut anywhere, come out of order in six micro-batches, with some that come twice; after half of them the stream is stopped and begun again."""
    whole = _vendor_b(spark, sf_dir).groupBy("conv_id").agg(joined_in_order(F.col("whole"), F.col("turn")).alias("whole"))
    size = (F.pmod(F.xxhash64("conv_id"), F.lit(90)) + 37).cast("int")
    cut = _cut(whole.select(F.col("conv_id").cast("string").alias("stream_id"), "whole", size.alias("size")))
    part = F.pmod(F.xxhash64("seq", "stream_id"), F.lit(2))
    path, checkpoint, told = scratch(spark, "chunks"), scratch(spark, "state"), scratch(spark, "deltas")
    files = 3 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    groups = max(LEAST_GROUPS, _t(spark, sf_dir, "conversations").count() // TURNS_A_GROUP)
    for half in (0, 1):  # chunks whose seq is divisible by 7 come in either half
        cut.where((part == half) | (F.col("seq") % 7 == 0)).repartition(files).write.mode("append").parquet(path)
        deltas = sse.decode_live(arrivals(spark, path, "stream_id string, seq long, chunk string, last boolean", 3, files), "b", groups=groups)
        drain(deltas, checkpoint, told)
    rows = spark.read.schema("stream_id string, seq long, text string, ended boolean").parquet(told)
    answer = text.trim_spaces(joined_in_order(F.col("text"), F.col("seq")))
    whole = rows.groupBy(F.col("stream_id").cast("long").alias("conv_id")).agg(answer.alias("text"), F.count_if(F.col("ended")).alias("ends"), (F.count(F.lit(1)) == F.max("seq") + 1).alias("each_once"))
    return whole


def _arriving(spark: SparkSession, sf_dir: str, path: str, slices: int) -> Iterator[DataFrame]:
    """The events as a stream that has more at each step: slice by slice of their time, each appended to what came before."""
    events = _t(spark, sf_dir, "events").select("event_id", F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    place = F.floor((F.unix_micros("ts") - (first or 0)) * slices / ((last or 0) - (first or 0) + 1))
    for i in range(slices):
        events.where(place == i).write.mode("append").parquet(path)
        yield spark.readStream.schema(events.schema).parquet(path)


#: Requests for which a partition of the state store is kept.
REQUESTS_A_PARTITION = 500_000


def live_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests admitted one by one as they come, in five micro-batches with a restart before each; counters are kept in the state store."""
    path, checkpoint, told = scratch(spark, "requests"), scratch(spark, "state"), scratch(spark, "admitted")
    width = max(4, _t(spark, sf_dir, "events").count() // REQUESTS_A_PARTITION)
    for requests in _arriving(spark, sf_dir, path, 5):
        drain(live.live_admission(requests, "user_id", "ts", "event_id", cap=3), checkpoint, told, store=ROCKSDB, partitions=width)
    rows = spark.read.schema("who string, day string, request long, ts timestamp, allowed boolean, used long, remaining long").parquet(told)
    return rows.select(F.col("request").alias("event_id"), F.col("who").cast("long").alias("user_id"), "day", "allowed", "used", "remaining")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored history for each run of customers, as a JSON array, with entries that lack an id or a report, and one that is no array."""
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.concat(F.lit("r"), k.cast("string")))
    report = F.when(k % 5 != 2, F.struct(F.col("c_name").alias("summary")))
    stored = _t(spark, sf_dir, "customer").groupBy(F.floor(k / 200)).agg(F.to_json(F.collect_list(F.struct(name.alias("id"), (k * 1000).alias("at"), report.alias("analysis")))).alias("json"))
    return stored.select("json").unionByName(spark.createDataFrame([("{}",), ("no json",), (None,)], "json string"))


def history_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, F4, K4."""
    entries = retention.without_ids(reports.history(_history(spark, sf_dir)), ["r3", "r8"])
    return entries.select("id", F.unix_timestamp("at").alias("at"), F.col("analysis.summary").alias("summary"))


def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries put before those stored; the newest 25 are kept."""
    entries = reports.history(_history(spark, sf_dir))
    new, path = F.substring("id", -1, 1).isin("3", "8"), scratch(spark, "history")
    sinks.append_history(entries.where(~new), entries.where(new), path)
    return spark.read.parquet(path).select("id", F.unix_timestamp("at").alias("at"))


def prepended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new rows before the old; and each row's place in a pool that begins at the seventh."""
    rows = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("pos"), "n_regionkey")
    both = retention.prepend(rows.where("n_regionkey = 2"), rows.where("n_regionkey <> 2"))
    rotated = ranking.rotated(F.col("n_nationkey"), F.lit(25), F.lit(7)).cast("long")
    return both.select("n_nationkey", F.col("pos._block").alias("block"), F.col("pos.pos").alias("place"), rotated.alias("rotated"))


def allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowances in headers and in JSON bodies, whole, partial and broken."""
    k = F.col("c_custkey")
    no = F.create_map().cast("map<string,string>")
    heads = F.when(k % 4 == 1, F.create_map(F.lit("X-Quota-Limit"), F.lit("40"), F.lit("X-Quota-Used"), (k % 40).cast("string"))).when(k % 4 == 2, F.create_map(*map(F.lit, ["X-Quota-Limit", "40", "X-Quota-Used", "x", "X-Quota-Remaining", "33", "X-Quota-Reset", "noon"])))
    heads = heads.when(k % 4 == 3, F.create_map(F.lit("X-Quota-Limit"), F.lit("many"))).otherwise(no)
    body = _pick(F.floor(k / 4), "no json", '{"enabled":true,"limit":40,"used":3,"reset":"noon"}', '{"enabled":false,"limit":"40","remaining":"y"}', '{"limit":null}', "[1]")
    told = _t(spark, sf_dir, "customer").select("c_custkey", quota.allowance_from_headers(heads).alias("h"), quota.allowance_from_json(body).alias("b"))
    fields = ["enabled", "limit", "used", "remaining", "reset"]
    return told.select("c_custkey", *[F.col(f"h.{f}").alias(f"h_{f}") for f in fields], *[F.col(f"b.{f}").alias(f"b_{f}") for f in fields])


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be tried, in order, and the first request of each."""
    k = F.col("c_custkey")
    own, custom = _pick(k, None, "", " key&1 "), F.when(F.col("c_nationkey") % 2 == 0, F.lit(" https://p.example/x// ")).otherwise(F.lit(""))
    shared = F.when(k % 5 != 0, F.lit("https://s.example"))
    chain = lambda v, direct: urls.credential_chain(own, custom, F.lit(" tok "), shared, _pick(k, "t", ""), v, direct)
    rows = _t(spark, sf_dir, "customer").select("c_custkey", chain("a", "https://a.example").alias("a"), chain("b", "https://b.example").alias("b"))
    ask = lambda c, auth: urls.request_url(F.get(c, 0)["kind"], F.get(c, 0)["base"], F.lit("/models"), F.get(c, 0)["secret"], auth)
    told = rows.select("c_custkey", F.array_join(F.transform("a", lambda c: c["kind"]), ",").alias("kinds"), ask(F.col("a"), "query").alias("a"), ask(F.col("b"), "bearer").alias("b"))
    return told.select("c_custkey", "kinds", *[F.col(f"{v}.{f}").alias(f"{v}_{f}") for v in "ab" for f in ("url", "header", "value")])


def picked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of picked files, page jumps and body sizes."""
    k = F.col("p_partkey")
    path, mime = F.concat("p_name", _pick(k, ".pdf", ".PDF", ".png", ".pdf.txt", "")), _pick(F.floor(k / 5), "application/pdf", "image/png", None)
    entered = _pick(k, "3", "0", "2.0", "x", "2.5", " 7", None, "1e1")
    body = F.repeat(F.lit("é"), (F.col("p_size") * 20).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", media.is_pdf(path).alias("by_name"), media.is_pdf(path, mime).alias("pdf"), media.page_jump(entered, F.col("p_size")).alias("jump"), media.body_fits(body, 1000).alias("fits"))


def picked_binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of pages, read back as picked files."""
    path = scratch(spark, "picked")
    pages = _t(spark, sf_dir, "pages").select(F.pmod("page_id", F.lit(16)).alias("bucket"), F.coalesce("html", F.lit("")).alias("html"))
    pages.write.partitionBy("bucket").option("compression", "none").text(path)
    found = files.read_picked(spark, path).where(~F.col("path").endswith("_SUCCESS"))
    bucket = F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("long")
    return found.groupBy(bucket.alias("bucket"), "kind").agg(F.sum("length").alias("bytes"), F.sum(F.octet_length("content").cast("long")).alias("read"))


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page documents written from the documents, a page each, and read back: some with objects in compressed streams, some encrypted, some cut short."""
    path = scratch(spark, "pdf")
    name = F.floor(F.col("doc_id") / 16)
    rest = F.pmod(name, F.lit(11))
    kind = F.when(rest == 5, "protected").when(rest == 7, "cut").when(rest % 2 == 0, "packed").otherwise("plain")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.concat(F.lit("f"), name.cast("string")).alias("file"), kind.alias("kind"))
    own = F.col("doc_id") % 3 != 0  # the others have their box from the tree
    width, height = F.when(own, 100 + F.col("n_chars") % 700 + 0.5), F.when(own, (200 + F.col("n_chars") % 900).cast("double"))
    pages = docs.select("file", "doc_id", "kind", width.alias("width"), height.alias("height"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 4 * 90).cast("int")).alias("rotation"), "text")
    for source in (PdfPages, PdfFiles):
        spark.dataSource.register(source)
    pages.repartition("file").sortWithinPartitions("file", "doc_id").write.format("pdf_files").mode("append").save(path)
    found = spark.read.format("pdf_pages").load(path)
    small = media.page_size(F.col("width"), F.col("height"), 260)
    file = F.regexp_extract("path", r"(f-?\d+)\.pdf$", 1)
    return found.select(file.alias("file"), "page", "pages", "width", "height", "rotation", "error", small["width"].alias("preview_width"), small["height"].alias("preview_height"))


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pictures' headers put together from the parts, of three kinds and all orientations, some cut short; and the sizes they are prepared to."""
    k, w, h = F.col("p_partkey"), 100 + F.col("p_size") * 73, (50 + F.col("p_partkey") * 7 % 4000)
    hex_of = lambda n, digits: F.lpad(F.hex(n.cast("long")), digits, "0")
    pairs = lambda n, digits: F.concat(*[F.substring(hex_of(n, digits), i, 2) for i in range(digits - 1, 0, -2)])  # least byte first
    turn = k % 8 + 1
    exif = {"big": F.concat(F.lit("4D4D002A00000008000101120003" + "00000001"), hex_of(turn, 4), F.lit("000000000000")), "little": F.concat(F.lit("49492A0008000000010012010300" + "01000000"), pairs(turn, 4), F.lit("000000000000"))}
    jpeg = lambda order: F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFE10022457869660000"), exif[order], F.lit("FFC4000401"  "02FFC0001108"), hex_of(h, 4), hex_of(w, 4), F.lit("03012200021101031101FFDA"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_of(w, 8), hex_of(h, 8), F.lit("0802000000"))
    riff = "5249464600010000" + "57454250"
    canvas = F.concat(F.lit(riff + "56503858" + "0A000000" + "08000000"), pairs(w - 1, 6), pairs(h - 1, 6), F.lit("45584946" + "1A000000"), exif["little"])
    lossless = F.concat(F.lit(riff + "5650384C" + "10000000" + "2F"), pairs((w - 1) + (h - 1) * 16384, 8), F.lit("00"))
    lossy = F.concat(F.lit(riff + "56503820" + "10000000" + "000000" + "9D012A"), pairs(w, 4), pairs(h, 4), F.lit("00"))
    whole = F.unhex(F.get(F.array(jpeg("big"), jpeg("little"), png, canvas, lossless, lossy), (k % 6).cast("int")))
    cut = F.when(k % 17 == 5, F.encode(F.lit("GIF89a"), "UTF-8")).when(k % 13 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    told = images.with_headers(_t(spark, sf_dir, "part").select("p_partkey", cut.alias("content")))
    size = media.image_size(F.col("image_width"), F.col("image_height"))
    return told.select("p_partkey", F.col("image_kind").alias("kind"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), "orientation", size["width"].alias("prepared_width"), size["height"].alias("prepared_height"))


def list_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in settings, and whether an origin is allowed."""
    k = F.col("s_suppkey")
    raw, origins = _pick(k, "a, b ,,c\n d", "", None, " one ", ",,\t"), _pick(k, "https://x.example, https://y.example", "https://x.example/", "", None)
    origin = _pick(F.floor(k / 2), "https://x.example", "https://y.example", None, "")
    joined = lambda c: F.array_join(c, "|")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", joined(text.split_list(raw)).alias("items"), joined(F.concat(text.split_list(raw), text.split_list(F.lit("z")))).alias("both"), joined(text.split_list(origins, ",")).alias("origins"), urls.allowed_origin(origin, origins).alias("allowed"))


def prompts_and_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X26, X28, X6, X22."""
    k = F.col("p_partkey")
    hint, label, ref = _pick(k, None, "  ", " look at U1\n"), _pick(k, "", None, "LED"), _pick(F.floor(k / 3), "", None, "D1")
    url = _pick(k, "data:image/png;base64,QUJD", "data:image/jpeg;charset=x;base64,A\nB", "http://x/data:a,b", "", None)
    parts = _t(spark, sf_dir, "part").select("p_partkey", text.prompt_with_hint("Read.", hint).alias("prompt"), text.first_text(label, ref, "Indicator").alias("heading"), text.data_url(url).alias("d"), keys.same_secret(F.col("p_brand"), _pick(k, "Brand#11", "Brand#12", None)).alias("same"))
    return parts.select("p_partkey", "prompt", "heading", F.col("d.mime_type").alias("mime"), F.col("d.base64").alias("data"), "same")


def flagged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: every key's row, with whether its pool holds it more than once."""
    k = F.col("c_custkey")
    key = F.when(k % 10 != 3, F.concat(F.lit("key-"), F.pmod(k * 7, F.lit(997)).cast("string")))
    pool = F.when(k % 10 != 7, F.col("c_mktsegment"))
    return keyreport.flagged(_t(spark, sf_dir, "customer").select("c_custkey", pool.alias("c_mktsegment"), key.alias("key")), "key", ["c_mktsegment"])


def attempt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts within the budgets of credentials and vendors."""
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 3).alias("credential"))
    return failover.within_budget(log, ["user_id"], "event_type", "credential", "event_id").select("user_id", "event_id")


def gated_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was shown stops retries; of failures that could all be retried the first is kept."""
    log = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "error").alias("retryable"), (F.col("event_type") == "signup").alias("emitted"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    told = failover.resolve(failover.gate_retries(log, ["user_id"]), ["user_id"], keep="first")
    return told.select("user_id", "outcome", F.coalesce("stopped_at", F.lit(0)).alias("stopped_at"), "error")


def _diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of eight blocks for each order, with a connection for each of its lines."""
    block = lambda c: F.concat(F.lit("b"), (F.col(c) % 8).cast("string"))
    line = F.struct("l_linenumber", block("l_partkey").alias("from"), block("l_suppkey").alias("to"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # said here, so that small reports, which take long, aren't put into few tasks
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), "l_linenumber", "l_partkey", "l_suppkey").repartition(width, "report_id").groupBy("report_id").agg(F.array_sort(F.collect_list(line)).alias("connections"))
    return layout.layouts(lines.withColumn("blocks", F.array(*[F.struct(F.lit(f"b{i}").alias("id")) for i in range(8)])))


def layout_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, section 2.10: where the blocks of each report stand, by our own rules."""
    return _diagrams(spark, sf_dir).select("report_id", "width", "height", F.explode("nodes").alias("n")).select("report_id", "n.id", "n.layer", "n.place", "n.x", "n.y", "width", "height")


def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each connection with the places of its two blocks."""
    return _diagrams(spark, sf_dir).select("report_id", F.explode("edges").alias("e")).select("report_id", "e.from", "e.to", "e.back", "e.side", "e.lane", "e.x1", "e.y1", "e.x2", "e.y2")


#: Models of the nested chain's lists with their place in the ranking, 0 for one that isn't usable; they are numbered from 0.
CHAIN_MODELS = [("m-2.5-pro", 4), ("m-flash-latest", 1), ("m-2.5-flash", 3), ("m-embedding-1", 0), ("m-oss", 7), ("m-flash-lite-1", 6), ("m-flash-preview", 5), ("m-pro-9", 2)]


def _nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each user of the events two vendors, none to two credentials each, their lists of models, and what each attempt would bring."""
    users = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("s"))
    vendors = users.select("user_id", "s", F.explode(F.array(F.lit(1), F.lit(2))).alias("vendor_pos")).withColumn("vendor", F.when(F.col("vendor_pos") == 1, "a").otherwise("b"))
    n = F.when(F.col("vendor_pos") == 1, F.col("s") % 2 + 1).otherwise(F.floor(F.col("s") / 2) % 3)
    some = F.explode_outer(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)))
    keys = vendors.select("*", some.alias("credential_pos")).withColumn("credential", F.concat(F.lit("k"), F.col("credential_pos").cast("string")))
    keys = keys.withColumn("first", F.when(F.col("vendor") == "a", "m-2.5-pro").otherwise("default"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("model")) for i, (name, _) in enumerate([*CHAIN_MODELS, ("default", 0)])])
    each = keys.where("credential IS NOT NULL").select("user_id", "s", "vendor", "vendor_pos", "credential", "credential_pos", F.explode(names).alias("m")).select("*", "m.*")
    models = each.where((F.col("i") < 8) & ((F.col("s") + F.col("credential_pos") + F.col("i")) % 4 != 0)).select("user_id", "vendor", "credential", "model")
    code = (F.col("s") * (F.col("i") + 3) + F.col("credential_pos") * 5 + F.col("vendor_pos") * 7) % 17
    error = F.concat_ws("/", "vendor", "credential", "model")
    return keys, models, each.select("user_id", "vendor", "credential", "model", (code == 0).alias("ok"), (code != 1).alias("retryable"), error.alias("error"))


def nested_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of vendors, credentials and ranked models, with what was announced."""
    done = failover.nested_chain(*_nested(spark, sf_dir), ["user_id"])
    return done.select("user_id", "attempt", "vendor", "credential", "model", "ok", "retryable", "error", "listed", "notice_to")


def nested_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How these chains ended."""
    return failover.chain_outcome(failover.nested_chain(*_nested(spark, sf_dir), ["user_id"]), ["user_id"])


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the ranked models, and '' where none is usable; among equal scores by the locale's order of names."""
    names = model_names(spark, sf_dir)
    tied = lambda *ends: _t(spark, sf_dir, "part").select(_pick(F.col("p_partkey"), *ends).alias("model"))
    sets = {"all": names, "unfit": names.where("model LIKE '%embedding%'"), "accents": tied("z-1", "é-1", "f-1", "Z-1"), "marks": tied("m-a-1", "m_a-1", "ma-1"), "case": tied("B-1", "a-1", "A-1", None)}
    told = [ranking.best_model(rows).select(F.lit(of).alias("of"), "model") for of, rows in sets.items()]
    return reduce(DataFrame.unionByName, told)


#: Ends of model names, by which every rule of X1 is met.
ENDS = ["-flash-latest", "-2.5-pro", "-2.5-flash-preview-09-2025", "-2.5-flash-lite", "-embedding-004", "/qwen3.6-27b", "-flash-image", "-tts", "-exp-1206", "-oss-120b", "-3.3-70b-versatile", "-pro-20240229", "-2.12-flash", "-beta-2024-05-06"]


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), _pick(F.col("p_partkey"), *ENDS))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_brand", name.alias("model"))


def demo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of the demo report for each supplier, by its blocks, and the canned answer to each as vendor a's stream."""
    suppliers = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("report_id"))
    parsed = reports.parse_reports(suppliers.withColumn("json", demo.report_json()))
    event = lambda word: F.concat(F.lit('data: {"candidates":[{"content":{"parts":[{"text":"'), word, F.lit('"}]}}]}\n\n'))
    words = suppliers.select(F.col("report_id").alias("stream_id"), F.posexplode(F.array(*map(F.lit, demo.answer_chunks()))).alias("seq", "word"))
    answer = provider("a").chat(words.select("stream_id", "seq", event(F.col("word")).alias("chunk")))
    blocks = reports.exploded(parsed, "blocks").select("report_id", "id", "kind")
    return blocks.unionByName(answer.select(F.col("stream_id").alias("report_id"), F.lit("answer").alias("id"), F.col("text").alias("kind")))


def live_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage from a stream of the events in three micro-batches, published as the latest row of each caller and day; the second is sent again, with other rows, and changes nothing."""
    table = LatestTable(spark, scratch(spark, "usage"), ["user_id", "day"], "requests", "user_id long, day date, requests long, used long", buckets=8)
    path, checkpoint = scratch(spark, "requests"), scratch(spark, "state")
    for i, requests in enumerate(_arriving(spark, sf_dir, path, 3)):
        live.publish_latest(live.live_daily_usage(requests, "user_id", "ts", cap=3), table, checkpoint)
        if i == 1:
            table.upsert(table.read().withColumn("requests", F.lit(-1).cast("long")), table.versions()[-1])
    return table.read().select("user_id", F.col("day").cast("string").alias("day"), "requests", "used")


QUERIES = {q.__name__: q for q in (
    report_normalize, exploded_edges, stored_reports, model_lists, sse_vendor_b, history_valid, history_append, prepended, allowances, credentials,
    picked_files, list_settings, prompts_and_headings, flagged_keys, attempt_budget, gated_failover, best_model, demo_blocks, live_usage, live_answers, live_admission, nested_attempts, nested_outcomes, layout_nodes, layout_edges, picked_binaries, pdf_pages, image_headers,
)}

POINTS = r"""CASE WHEN regexp_matches(model, 'embedding|imagen|veo|tts|whisper|guard|moderation|aqa|rerank') OR regexp_matches(model, '-image($|-)|image-gen|nano-banana') THEN -100::DOUBLE ELSE
  CASE WHEN contains(model, 'flash') THEN 30::DOUBLE ELSE 0 END + CASE WHEN contains(model, 'pro') THEN 22::DOUBLE ELSE 0 END + CASE WHEN contains(model, 'latest') THEN 15::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(model, 'preview|exp|beta') THEN -10::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(model, '\d{3,4}-\d{2}-\d{2}|\d{6,8}') THEN -5::DOUBLE ELSE 0 END + CASE WHEN contains(model, 'lite') THEN -20::DOUBLE ELSE 0 END
  + (coalesce(TRY_CAST(regexp_extract(model, '(?:^|[-/a-z])(\d{1,2})(?:\.(\d+))?(?:[^\d.a-z]|$)', 1) AS DOUBLE) * 2, 0) + coalesce(TRY_CAST(regexp_extract(model, '(?:^|[-/a-z])(\d{1,2})(?:\.(\d+))?(?:[^\d.a-z]|$)', 2) AS DOUBLE) / 10, 0)) END"""
MODELS = f"models AS (SELECT p_partkey, p_brand, replace(lower(p_name), ' ', '-') || ({ENDS})[p_partkey % {len(ENDS)} + 1] AS model FROM part)"

#: A chain's candidates in their order, and of those what happened: a row follows the one before it if that failed and could be retried.
NESTED = f"""WITH RECURSIVE u AS (SELECT user_id, sum(event_id)::BIGINT AS s FROM events GROUP BY user_id),
v AS (SELECT *, CASE vp WHEN 1 THEN s % 2 + 1 ELSE s // 2 % 3 END AS n FROM u, (VALUES (1, 'a', 'm-2.5-pro'), (2, 'b', 'default')) t(vp, vendor, first)),
k AS (SELECT *, unnest(CASE WHEN n = 0 THEN [NULL] ELSE range(1, n + 1) END) AS cp FROM v),
names AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{name}', {rank})" for i, (name, rank) in enumerate([*CHAIN_MODELS, ("default", 0)]))}) t(i, model, place)),
c AS (SELECT k.*, i, model, CASE WHEN model = first THEN 1 ELSE 1 + row_number() OVER (PARTITION BY user_id, vp, cp, model = first ORDER BY place) END AS mp
  FROM k, names WHERE cp IS NOT NULL AND (model = first OR (place > 0 AND (s + cp + i) % 4 <> 0))
  UNION ALL SELECT k.*, NULL, NULL, 1 FROM k WHERE cp IS NULL),
d AS (SELECT *, lead(model) OVER (PARTITION BY user_id, vp, cp ORDER BY mp) AS following, (s * (i + 3) + cp * 5 + vp * 7) % 17 AS code FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, vp ORDER BY cp, mp) AS budget FROM d WHERE mp <= 5),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY vp, cp, mp) AS attempt, coalesce(code = 0, FALSE) AS ok, coalesce(code > 1, FALSE) AS retryable FROM e WHERE budget <= 7),
h AS (SELECT * FROM f WHERE attempt = 1 UNION ALL SELECT f.* FROM f JOIN h ON f.user_id = h.user_id AND f.attempt = h.attempt + 1 WHERE h.retryable),
a AS (SELECT user_id, attempt::INTEGER AS attempt, vp, vendor, 'k' || cp AS credential, model, ok, retryable, CASE WHEN cp IS NULL THEN 'no credentials' WHEN NOT ok THEN vendor || '/k' || cp || '/' || model END AS error,
  retryable AND mp = 1 AS listed, CASE WHEN retryable THEN following END AS notice_to FROM h)"""

def _sweep(n: int, near: str, other: str) -> str:
    return f"""p{n} AS (SELECT p.r, p.n, layer, row_number() OVER (PARTITION BY p.r, layer ORDER BY coalesce(m.mean, place * 1000), place) - 1 AS place FROM p{n - 1} p
  LEFT JOIN (SELECT f.r, f.{other} AS n, sum(q.place) * 1000 // count(*) AS mean FROM f JOIN p{n - 1} q ON q.r = f.r AND q.n = f.{near} WHERE NOT back GROUP BY f.r, f.{other}) m ON m.r = p.r AND m.n = p.n)"""


LAYOUT = f"""WITH RECURSIVE e AS (SELECT l_orderkey AS r, l_linenumber AS pos, l_partkey % 8 AS u, l_suppkey % 8 AS v FROM lineitem WHERE l_partkey % 8 <> l_suppkey % 8),
nodes AS (SELECT r, n FROM (SELECT DISTINCT l_orderkey AS r FROM lineitem), range(8) t(n)),
reach (r, a, b) AS (SELECT DISTINCT r, u, v FROM e UNION SELECT reach.r, a, e.v FROM reach JOIN e ON e.r = reach.r AND e.u = reach.b),
f AS (SELECT e.*, v < u AND reach.r IS NOT NULL AS back FROM e LEFT JOIN reach ON reach.r = e.r AND a = v AND b = u),
paths (r, n, d) AS (SELECT r, n, 0 FROM nodes UNION SELECT p.r, f.v, d + 1 FROM paths p JOIN f ON f.r = p.r AND f.u = p.n WHERE NOT back),
lay AS (SELECT r, n, max(d) AS layer FROM paths GROUP BY r, n),
p0 AS (SELECT *, row_number() OVER (PARTITION BY r, layer ORDER BY n) - 1 AS place FROM lay),
{_sweep(1, "u", "v")}, {_sweep(2, "v", "u")}, {_sweep(3, "u", "v")}, {_sweep(4, "v", "u")},
g AS (SELECT f.*, back OR t.layer - s.layer <> 1 AS side, s.place * 200 + 84 AS x1, s.layer * 120 + 64 AS y1, t.place * 200 + 84 AS x2, t.layer * 120 AS y2 FROM f JOIN p4 s ON s.r = f.r AND s.n = u JOIN p4 t ON t.r = f.r AND t.n = v),
box AS (SELECT r, max(place * 200 + 168) AS w, max(layer * 120 + 64) AS h FROM p4 GROUP BY r), lanes AS (SELECT r, count(*) AS n FROM g WHERE side GROUP BY r)"""

ORACLE_SQL = {
    "picked_binaries": "SELECT page_id % 16 AS bucket, 'image' AS kind, sum(octet_length(encode(coalesce(html, ''))) + 1)::BIGINT AS bytes, sum(octet_length(encode(coalesce(html, ''))) + 1)::BIGINT AS \"read\" FROM pages GROUP BY ALL",
    "pdf_pages": """
WITH d AS (SELECT doc_id // 16 AS f, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) AS page, count(*) OVER (PARTITION BY doc_id // 16) AS pages,
  CASE WHEN doc_id % 3 <> 0 THEN 100 + n_chars % 700 + 0.5::DOUBLE ELSE 612 END AS w, CASE WHEN doc_id % 3 <> 0 THEN 200 + n_chars % 900::DOUBLE ELSE 792 END AS h, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 4 * 90 ELSE 0 END AS turn FROM documents),
s AS (SELECT *, CASE WHEN turn IN (90, 270) THEN h ELSE w END AS width, CASE WHEN turn IN (90, 270) THEN w ELSE h END AS height, f % 11 AS kind FROM d)
SELECT 'f' || f AS file, page::INTEGER AS page, pages::INTEGER AS pages, width::DOUBLE AS width, height::DOUBLE AS height, turn::INTEGER AS rotation, NULL::VARCHAR AS error,
  greatest(1, floor(width * (260.0::DOUBLE / greatest(width, height)) + 0.5))::BIGINT AS preview_width, greatest(1, floor(height * (260.0::DOUBLE / greatest(width, height)) + 0.5))::BIGINT AS preview_height FROM s WHERE kind NOT IN (5, 7)
UNION ALL SELECT DISTINCT 'f' || f, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, NULL::DOUBLE, NULL::INTEGER, CASE kind WHEN 5 THEN 'password-protected' ELSE 'damaged' END, NULL::BIGINT, NULL::BIGINT FROM s WHERE kind IN (5, 7)""",
    "image_headers": """
WITH p AS (SELECT p_partkey, 100 + p_size * 73 AS w, 50 + p_partkey * 7 % 4000 AS h, p_partkey % 6 AS form, p_partkey % 17 = 5 AS other, p_partkey % 13 = 0 AS cut, CASE WHEN p_partkey % 6 IN (0, 1, 3) THEN p_partkey % 8 + 1 ELSE 1 END AS turn FROM part),
s AS (SELECT *, CASE WHEN turn >= 5 THEN h ELSE w END AS width, CASE WHEN turn >= 5 THEN w ELSE h END AS height, NOT other AND NOT cut AS sound FROM p)
SELECT p_partkey, CASE WHEN NOT other THEN ['jpeg', 'jpeg', 'png', 'webp', 'webp', 'webp'][form + 1] END AS kind, CASE WHEN sound THEN width::BIGINT END AS width, CASE WHEN sound THEN height::BIGINT END AS height, CASE WHEN sound THEN turn::INTEGER END AS orientation,
  CASE WHEN sound THEN floor(width * least(1.0, 3072.0::DOUBLE / greatest(width, height)) + 0.5)::BIGINT END AS prepared_width, CASE WHEN sound THEN floor(height * least(1.0, 3072.0::DOUBLE / greatest(width, height)) + 0.5)::BIGINT END AS prepared_height FROM s""",
    "layout_nodes": f"{LAYOUT} SELECT r AS report_id, 'b' || p4.n AS id, layer, place::INTEGER AS place, (place * 200)::INTEGER AS x, layer * 120 AS y, (w + 14 * coalesce(lanes.n, 0))::INTEGER AS width, h AS height FROM p4 JOIN box USING (r) LEFT JOIN lanes USING (r)",
    "layout_edges": f"""{LAYOUT} SELECT r AS report_id, 'b' || u AS "from", 'b' || v AS "to", back, side, CASE WHEN side THEN (count(*) FILTER (WHERE side) OVER (PARTITION BY r ORDER BY pos, u, v ROWS UNBOUNDED PRECEDING) - 1)::INTEGER END AS lane, x1::INTEGER AS x1, y1, x2::INTEGER AS x2, y2 FROM g""",
    "nested_attempts": f"{NESTED} SELECT user_id, attempt, vendor, credential, model, ok, retryable, error, listed, notice_to FROM a",
    "nested_outcomes": f"""{NESTED}
SELECT user_id, CASE WHEN bool_or(ok) THEN 'success' WHEN bool_or(NOT ok AND NOT retryable) THEN 'fatal' ELSE 'exhausted' END AS outcome, max(vendor) FILTER (WHERE ok) AS vendor, max(credential) FILTER (WHERE ok) AS credential,
  max(model) FILTER (WHERE ok) AS model, CASE WHEN bool_or(ok) THEN NULL WHEN bool_or(NOT retryable) THEN arg_max(error, attempt) ELSE arg_max(error, attempt) FILTER (WHERE vp = 1) END AS error,
  count(model) AS attempts, count(*) FILTER (WHERE listed) AS lists, count(notice_to) AS notices FROM a GROUP BY user_id""",
    "report_normalize": """
WITH p AS (SELECT p_partkey, p_name, p_partkey % 6 < 2 AS bare, p_size % 3 AS s, p_partkey % 5 = 2 AS image, p_partkey % 4 = 0 AS untitled, p_partkey % 11 <> 0 AS parsed FROM part),
r AS (SELECT *, CASE WHEN bare THEN '' ELSE 'b0>b1' || CASE s WHEN 0 THEN ',b1>?,b0>b1' WHEN 1 THEN '' ELSE ',b2>b1' END END AS edges FROM p)
SELECT p_partkey, parsed, CASE WHEN parsed THEN CASE WHEN untitled THEN 'Untitled sheet' ELSE p_name END END AS title, CASE WHEN parsed AND untitled THEN 'Unknown' END AS circuit, CASE WHEN parsed THEN NOT image END AS schematic,
  CASE WHEN parsed THEN CASE WHEN bare THEN 0 ELSE 3 END END AS blocks, CASE WHEN parsed THEN 0 END AS grounds, CASE WHEN parsed THEN edges END AS edges, CASE WHEN parsed THEN p_name END AS summary, CAST(NULL AS VARCHAR) AS confidence,
  CASE WHEN parsed THEN CASE WHEN image OR bare THEN 'notes' ELSE 'blocks,notes' END ELSE '' END AS sections,
  CASE WHEN parsed THEN '{"other":1,"summary":"' || p_name || '","isSchematic":' || CASE WHEN image THEN 'false' ELSE 'true' END
    || ',"sheet":' || CASE WHEN untitled THEN '{"circuitType":"Unknown","title":"Untitled sheet"}' ELSE '{"extra":{"a":"é","b":1},"title":"' || p_name || '"}' END
    || ',"blocks":' || CASE WHEN bare THEN '[]' ELSE '[{"id":"b0","zz":{"deep":[1,null]}},{"id":"b1"},' || CASE s WHEN 0 THEN '{"label":"no id"}' ELSE '{"id":"b2"}' END || ']' END
    || ',"connections":' || CASE WHEN bare THEN '[]' ELSE '[{"from":"b0","to":"b1","weight":0.5}' || CASE s WHEN 0 THEN ',{"from":"b1"},{"from":"b0","to":"b1"}' WHEN 1 THEN '' ELSE ',{"from":"b2","to":"b1"}' END || ']' END
    || ',"powerRails":[],"grounds":[],"indicators":[],"testPoints":[],"signals":[],"connectors":[],"components":[],"theoryOfOperation":[],"safetyNotes":[],"unreadable":[],"notes":["n"]}' END AS exported,
  CASE WHEN parsed AND NOT untitled THEN 'é' END AS pretty_extra FROM r""",
    "exploded_edges": """
WITH p AS (SELECT p_partkey AS report_id, p_size % 3 AS s FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 6 >= 2),
e AS (SELECT report_id, 0 AS pos, 'b0' AS "from", 'b1' AS "to" FROM p
  UNION ALL SELECT report_id, CASE WHEN s = 0 THEN 1 ELSE 1 END, CASE WHEN s = 0 THEN 'b1' ELSE 'b2' END, CASE WHEN s = 0 THEN NULL ELSE 'b1' END FROM p WHERE s <> 1
  UNION ALL SELECT report_id, 2, 'b0', 'b1' FROM p WHERE s = 0)
SELECT report_id, CAST(pos AS BIGINT) AS pos, "from", "to" FROM e""",
    "stored_reports": "SELECT c_custkey, c_custkey % 7 > 2 AS parsed, CASE WHEN c_custkey % 7 > 2 THEN c_name END AS title FROM customer",
    "model_lists": "SELECT 'a' AS vendor, 'm-' || p_partkey AS model FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'b', 'b-' || p_partkey FROM part",
    "sse_vendor_b": r"SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn), '\A[\t\n\v\f\r ]+|[\t\n\v\f\r ]+\z', '', 'g') AS text FROM conversations GROUP BY conv_id",
    "history_valid": "SELECT 'r' || c_custkey AS id, c_custkey AS at, c_name AS summary FROM customer WHERE c_custkey % 5 IN (3, 4) AND c_custkey NOT IN (3, 8)",
    "history_append": "SELECT 'r' || c_custkey AS id, c_custkey AS at FROM customer WHERE c_custkey % 5 IN (3, 4) ORDER BY c_custkey DESC, id LIMIT 25",
    "prepended": """
SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END AS block, n_nationkey AS place, CAST((n_nationkey - 7 + 25) % 25 AS BIGINT) AS rotated FROM nation""",
    "allowances": """
WITH c AS (SELECT c_custkey, c_custkey % 4 AS h, c_custkey // 4 % 5 AS b FROM customer)
SELECT c_custkey, CASE WHEN h > 0 THEN TRUE END AS h_enabled, CASE h WHEN 1 THEN 40::DOUBLE WHEN 2 THEN 40 END AS h_limit, CASE h WHEN 1 THEN (c_custkey % 40)::DOUBLE WHEN 3 THEN 0 END AS h_used,
  CASE h WHEN 1 THEN 0::DOUBLE WHEN 2 THEN 33 WHEN 3 THEN 0 END AS h_remaining, CASE h WHEN 2 THEN 'noon' WHEN 0 THEN NULL ELSE '' END AS h_reset,
  CASE b WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE END AS b_enabled, CASE b WHEN 1 THEN 40::DOUBLE WHEN 2 THEN 40 WHEN 3 THEN 0 END AS b_limit, CASE b WHEN 1 THEN 3::DOUBLE WHEN 2 THEN 0 WHEN 3 THEN 0 END AS b_used,
  CASE b WHEN 1 THEN 0::DOUBLE WHEN 3 THEN 0 END AS b_remaining, CASE b WHEN 1 THEN 'noon' WHEN 2 THEN '' WHEN 3 THEN '' END AS b_reset FROM c""",
    "credentials": """
WITH c AS (SELECT c_custkey, c_custkey % 3 = 2 AS own, c_nationkey % 2 = 0 AS custom, c_custkey % 5 <> 0 AS shared, CASE WHEN c_custkey % 2 = 0 THEN 't' ELSE '' END AS token FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN own THEN 'own' END, CASE WHEN custom THEN 'custom' END, CASE WHEN shared THEN 'shared' END) AS kinds,
  CASE WHEN own THEN 'https://a.example/models?key=key%261' WHEN custom THEN 'https://p.example/x/models' WHEN shared THEN 'https://s.example/models' END AS a_url,
  CASE WHEN own THEN NULL WHEN custom OR shared AND token <> '' THEN 'X-App-Token' END AS a_header, CASE WHEN own THEN NULL WHEN custom THEN 'tok' WHEN shared AND token <> '' THEN token END AS a_value,
  CASE WHEN own THEN 'https://b.example/models' WHEN custom THEN 'https://p.example/x/groq/models' WHEN shared THEN 'https://s.example/groq/models' END AS b_url,
  CASE WHEN own THEN 'Authorization' WHEN custom OR shared AND token <> '' THEN 'X-App-Token' END AS b_header, CASE WHEN own THEN 'Bearer key&1' WHEN custom THEN 'tok' WHEN shared AND token <> '' THEN token END AS b_value FROM c""",
    "picked_files": """
SELECT p_partkey, p_partkey % 5 < 2 AS by_name, p_partkey % 5 < 2 OR p_partkey // 5 % 3 = 0 AS pdf,
  CASE WHEN ([3, 0, 2, NULL, NULL, 7, NULL, 10])[p_partkey % 8 + 1] BETWEEN 1 AND p_size THEN CAST(([3, 0, 2, NULL, NULL, 7, NULL, 10])[p_partkey % 8 + 1] AS BIGINT) END AS jump, p_size * 40 <= 1000 AS fits FROM part""",
    "list_settings": """
WITH s AS (SELECT s_suppkey, (['a|b|c|d', '', '', 'one', ''])[s_suppkey % 5 + 1] AS items, (['https://x.example|https://y.example', 'https://x.example/', '', ''])[s_suppkey % 4 + 1] AS origins, (['https://x.example', 'https://y.example', NULL, ''])[s_suppkey // 2 % 4 + 1] AS origin FROM supplier)
SELECT s_suppkey, items, concat_ws('|', nullif(items, ''), 'z') AS "both", origins, coalesce(list_contains(string_split(nullif(origins, ''), '|'), coalesce(origin, '')), FALSE) AS allowed FROM s""",
    "prompts_and_headings": """
SELECT p_partkey, (['Read.', 'Read.', 'Read.' || chr(10) || chr(10) || 'look at U1'])[p_partkey % 3 + 1] AS prompt, coalesce(([NULL, NULL, 'LED'])[p_partkey % 3 + 1], ([NULL, NULL, 'D1'])[p_partkey // 3 % 3 + 1], 'Indicator') AS heading,
  (['image/png', 'image/jpeg', NULL, NULL, NULL])[p_partkey % 5 + 1] AS mime, (['QUJD', 'A' || chr(10) || 'B', NULL, NULL, NULL])[p_partkey % 5 + 1] AS data, p_brand = (['Brand#11', 'Brand#12', NULL])[p_partkey % 3 + 1] AS same FROM part""",
    "flagged_keys": """
WITH k AS (SELECT CASE WHEN c_custkey % 10 <> 7 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 <> 3 THEN 'key-' || c_custkey * 7 % 997 END AS key FROM customer)
SELECT c_mktsegment, left(sha256(key), 8) AS fp, left(key, 4) AS prefix, CAST(length(key) AS INTEGER) AS length, count(*) OVER (PARTITION BY c_mktsegment, key) > 1 AS duplicate FROM k""",
    "attempt_budget": """
WITH c AS (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 ORDER BY event_id) <= 5)
SELECT user_id, event_id FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 7""",
    "gated_failover": """
WITH e AS (SELECT user_id, event_id, event_type, min(event_id) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id) AS shown FROM events),
s AS (SELECT user_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS ok, min(event_id) FILTER (WHERE event_type <> 'purchase' AND (event_type = 'error' OR event_id >= shown)) AS fatal, min(event_id) FILTER (WHERE event_type <> 'purchase') AS first FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN ok < coalesce(fatal, ok + 1) THEN 'success' WHEN fatal IS NOT NULL THEN 'fatal' ELSE 'exhausted' END AS outcome, coalesce(least(ok, fatal), 0) AS stopped_at,
  CASE WHEN ok < coalesce(fatal, ok + 1) THEN NULL WHEN fatal IS NOT NULL THEN 'e' || fatal ELSE 'e' || first END AS error FROM s""",
    "best_model": f"WITH {MODELS}, s AS (SELECT model, {POINTS} AS score FROM models) SELECT 'all' AS \"of\", (SELECT model FROM s WHERE score > -100 ORDER BY score DESC, model LIMIT 1) AS model UNION ALL SELECT 'unfit', '' UNION ALL SELECT 'accents', 'é-1' UNION ALL SELECT 'marks', 'm_a-1' UNION ALL SELECT 'case', 'a-1'",
    "demo_blocks": "SELECT s_suppkey AS report_id, id, kind FROM supplier, (VALUES ('mains', 'input'), ('reg', 'regulator'), ('out', 'output'), ('answer', 'The regulator holds the output at twelve volts.')) t(id, kind)",
    "live_answers": r"SELECT conv_id, regexp_replace(string_agg(text, '' ORDER BY turn), '\A[\t\n\v\f\r ]+|[\t\n\v\f\r ]+\z', '', 'g') AS text, CAST(1 AS BIGINT) AS ends, TRUE AS each_once FROM conversations GROUP BY conv_id",
    "live_admission": """
WITH n AS (SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, user_id, day, place <= 3 AS allowed, least(place, 3) AS used, 3 - least(place, 3) AS remaining FROM n""",
    "live_usage": "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS requests, least(count(*), 3) AS used FROM events GROUP BY ALL",
}
