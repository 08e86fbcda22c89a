import json
import random

from pyspark.sql import functions as F

from sheetloom.operators import failover, graph, keyreport, lookups, quota, ranking, retention, transcript
from sheetloom.sources import demo, files, reports, sinks


def test_prune_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", "a"), ("a", "a"), (None, "a"), ("b", "a"), ("b", "a"), (None, None)], "`from` string, `to` string")
    rows = sorted(map(tuple, graph.prune_edges(edges, nodes).collect()), key=str)
    assert rows == sorted([("a", "b"), (None, "a"), ("b", "a"), ("b", "a")], key=str)
    assert graph.prune_edges(edges, nodes.where("id <> 'a'")).count() == 0


def test_model_scores(spark):
    want = {
        "gemini-flash-latest": 45, "gemini-2.12-flash": 35.2, "gemini-2.5-flash": 34.5, "gemini-2.5-pro": 26.5, "gemini-2.5-flash-preview-09-2025": 24.5, "gemini-2.5-pro-preview-05-06": 16.5,
        "gemini-2.5-flash-lite": 14.5, "qwen/qwen3.6-27b": 6.6, "llama-3.3-70b-versatile": 6.3, "gpt-oss-120b": 0, "gpt-oss-20b": 0, "gemini-2.5-flash-image": -100, "text-embedding-004": -100,
    }
    names = spark.createDataFrame([(n,) for n in want], "model string")
    got = {r.model: r.s for r in names.select("model", ranking.model_score(F.col("model")).alias("s")).collect()}
    assert all(abs(got[n] - w) < 1e-9 for n, w in want.items())
    ranked = [r.model for r in ranking.rank_models(names).orderBy("rank").collect()]
    assert ranked[:3] == ["gemini-flash-latest", "gemini-2.12-flash", "gemini-2.5-flash"] and "text-embedding-004" not in ranked
    assert ranked[-2:] == ["gpt-oss-120b", "gpt-oss-20b"]
    assert ranking.best_model(names).first().model == "gemini-flash-latest" and ranking.best_model(names.limit(0)).first().model == ""
    tried = spark.createDataFrame([("gemini-flash-latest",), ("other",)], "model string")
    assert ranking.next_untried(ranking.rank_models(names), tried).first().model == "gemini-2.12-flash"
    assert ranking.next_untried(ranking.rank_models(names), names).count() == 0


def test_one_task_ranks_only_short_lists(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(ranking, "MOST_MODELS", 3)
    names = spark.createDataFrame([(f"m{i}",) for i in range(4)], "model string")
    assert ranking.rank_models(names.limit(3)).count() == 3
    with pytest.raises(ValueError):
        ranking.rank_models(names)


def test_orders(spark):
    rows = spark.createDataFrame([(0, "bias"), (1, "new"), (2, "input"), (3, None), (4, "derived"), (5, "input")], "pos int, kind string")
    order = rows.orderBy(ranking.order_position(F.col("kind"), ranking.RAIL_ORDER), "pos")
    assert [r.pos for r in order.collect()] == [1, 3, 2, 5, 4, 0]
    assert [r.p for r in spark.range(4).select(ranking.rotated(F.col("id"), F.lit(4), F.lit(3)).alias("p")).collect()] == [1, 2, 3, 0]


def test_failover(spark):
    log = [("a", 1, False, True, "e1"), ("a", 2, True, None, None), ("a", 3, False, False, "never"), ("b", 1, False, True, "f1"), ("b", 2, False, True, "f2"), ("c", 1, False, True, "g1"), ("c", 2, False, False, "g2"), ("c", 3, True, None, None), ("d", 1, False, True, "h1"), ("d", 2, False, True, "h2"), ("d", 3, True, None, None)]
    rows = spark.createDataFrame(log, "c string, pos int, ok boolean, retryable boolean, error string")
    get = lambda **k: {r.c: tuple(r)[1:] for r in failover.resolve(rows, ["c"], **k).collect()}
    assert get(budget=2) == {"a": ("success", 2, 2, None), "b": ("exhausted", None, 2, "f2"), "c": ("fatal", 2, 2, "g2"), "d": ("exhausted", None, 2, "h2")}
    assert get(keep="first")["b"][3] == "f1" and get()["d"] == ("success", 3, 3, None)
    many = spark.createDataFrame([("x", v, c, p) for v in (1, 2) for c in (1, 2) for p in range(c * 10, c * 10 + 6)], "chain string, vendor int, credential int, pos int")
    kept = failover.within_budget(many, ["chain"]).collect()
    assert sorted((r.vendor, r.credential, r.pos) for r in kept) == [(v, c, p) for v in (1, 2) for c, n in ((1, 5), (2, 2)) for p in range(c * 10, c * 10 + n)]


def test_quota(spark):
    rows = [(i, "u", "2024-01-01 10:00:00") for i in range(4)] + [(9, "u", "2024-01-02 00:00:00"), (10, None, "2024-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "id int, who string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.allowed, r.used, r.remaining, r.percent) for r in quota.admit(frame, "who", "ts", ["id"], cap=3).collect()}
    assert got == {0: (True, 1, 2, 33), 1: (True, 2, 1, 67), 2: (True, 3, 0, 100), 3: (False, 3, 0, 100), 9: (True, 1, 2, 33), 10: (True, 1, 2, 33)}
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("who"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 37 % 200_000).alias("ts"))
    one, parts = (quota.admit(rows, "who", "ts", ["id"], cap=7, salts=k) for k in (1, 5))
    assert one.columns == parts.columns and one.exceptAll(parts).count() == 0 and parts.count() == 3000
    used = {(r.who, str(r.day)): (r.used, r.refused) for r in quota.daily_usage(frame, "who", "ts", 3).collect()}
    assert used[("u", "2024-01-01")] == (3, 1)
    day = F.lit("2024-02-28").cast("date")
    row = spark.range(1).select(quota.slot_key(F.lit(None).cast("string"), day).alias("k"), quota.reset_at(day).cast("string").alias("r"), quota.percent_used(F.lit(1), F.lit(0)).alias("p")).first()
    assert tuple(row) == ("rl:2024-02-28:unknown", "2024-02-29 00:00:00", 0)
    heads = F.create_map(F.lit("X-Quota-Limit"), F.lit("40"), F.lit("X-Quota-Used"), F.lit("x"))
    a, b, c = spark.range(1).select(quota.allowance_from_headers(heads), quota.allowance_from_json(F.lit('{"enabled":true,"limit":"40"}')), quota.allowance_from_json(F.lit("no"))).first()
    assert tuple(a) == (True, 40.0, None, 0.0, "") and tuple(b) == (True, 40.0, 0.0, 0.0, "") and c is None


def shed(entries, budget):
    """Step by step: drop the oldest extra, then the oldest entry, until all fits. entries are newest first."""
    left = [[b, x] for b, x in entries]
    while left and sum(b + x for b, x in left) > budget:
        oldest = next((e for e in reversed(left) if e[1]), None)
        if oldest:
            oldest[1] = 0
        else:
            left.pop()
    return [(i < len(left), i < len(left) and left[i][1] > 0) for i in range(len(entries))]


def test_byte_budget(spark):
    dice, rows, want = random.Random(5), [], {}
    for g in range(60):
        entries = [(dice.randint(1, 9), dice.choice([0, 0, 5, 20])) for _ in range(dice.randint(1, 8))]
        budget_rows = shed(entries, 40)
        for i, (b, x) in enumerate(entries):
            rows.append((g, 100 - i, b, x))
            want[g, 100 - i] = budget_rows[i]
    frame = spark.createDataFrame(rows, "g int, at int, base int, extra int")
    got = {(r.g, r.at): (r.keep_entry, r.keep_extra) for r in retention.byte_budget(frame, ["g"], "at", [], "base", "extra", 40).collect()}
    assert got == want
    cut = retention.byte_budget(frame, ["g"], "at", [], "base", "extra", 40, slices=F.floor(F.col("at") / 3))
    assert {(r.g, r.at): (r.keep_entry, r.keep_extra) for r in cut.collect()} == want


def test_retention(spark):
    rows = spark.createDataFrame([(i, i // 2, "c") for i in range(60)], "id int, at int, chat string")
    assert [r.id for r in retention.newest(rows, "at", ["id"]).collect()][:4] == [58, 59, 56, 57]
    assert retention.newest(rows, "at", ["id"]).count() == 25
    new = retention.replace_value(rows, spark.createDataFrame([(3, "new"), (99, "x"), (4, None)], "id int, chat string"), "id", "chat")
    assert {r.id: r.chat for r in new.collect() if r.chat != "c"} == {3: "new", 4: None} and new.count() == 60
    assert retention.without_ids(rows, [1, 2]).count() == 58
    both = retention.prepend(rows.where("id = 7"), rows.where("id < 2"), "at").orderBy("at").collect()
    assert [r.id for r in both] == [7, 0, 1]


def test_keys_and_lookups(spark):
    rows = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("p", "k1"), ("q", "k1")], "pool string, key string")
    assert {r.pool: (r["count"], r.distinct, r.duplicates) for r in keyreport.pool_report(rows, "key", ["pool"]).collect()} == {"p": (3, 2, 1), "q": (1, 1, 0)}
    assert sorted((r.pool, r.prefix, r.duplicate) for r in keyreport.flagged(rows, "key", ["pool"]).collect()) == [("p", "k1", True), ("p", "k1", True), ("p", "k2", False), ("q", "k1", False)]
    table = spark.createDataFrame([("k1", "one"), ("k1", "uno")], "k string, v string")
    assert sorted(r.v for r in lookups.lookup(rows, table, "key", "k", "v", "none").collect()) == ["none", "one", "one", "one"]


def test_transcripts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", False), (1, 1, "model", "b", True), (2, 0, "user", "q", False), (2, 1, "model", "", True)], "c int, turn int, role string, text string, stopped boolean")
    assert {r.c: r.transcript for r in transcript.transcripts(rows, "c", "turn", "role", "text").collect()}[1] == "user: a\nassistant: b"
    left = {(r.c, r.turn): r.text for r in transcript.mark_stopped(rows, "c", "turn", "text", "stopped").collect()}
    assert left == {(1, 0): "a", (1, 1): "b\n\n[stopped]", (2, 0): "q"}
    more = rows.unionByName(spark.createDataFrame([(3, 0, "user", "a", True), (4, 0, "user", "a", False), (4, 1, "model", "b", False), (4, 2, "user", "again", True), (5, 0, "system", "s", False), (5, 1, "model", None, True), (6, 0, "user", "a", None), (6, 1, "model", "b", None)], rows.schema))
    left = {(r.c, r.turn): r.text for r in transcript.mark_stopped(more, "c", "turn", "text", "stopped", "role").collect()}
    assert left == {(1, 0): "a", (1, 1): "b\n\n[stopped]", (4, 0): "a", (4, 1): "b", (5, 0): "s", (6, 0): "a", (6, 1): "b"}


def test_reports(spark, tmp_path):
    rows = demo.report_rows(spark).unionByName(spark.createDataFrame([(2, "no json"), (3, "[1]"), (4, None), (5, '{"isSchematic": false, "extra": 1}'), (6, '{"blocks":[{"id":"a"},{"id":"b"},{"x":[{"y":1}]},{"id":7}],"connections":[{"from":"a","to":"b","w":0.25},{"from":"a","to":"a"},{"from":"a","to":"z"},{"from":"a"},{"from":"a","to":null},{"from":"a","to":"7"},{"from":7,"to":"a"}],"sheet":{"k":{"l":null}},"grounds":null,"later":{"m":"é"},"isSchematic":null}')], "report_id long, json string"))
    parsed = reports.parse_reports(rows).cache()
    got = {r.report_id: r for r in parsed.collect()}
    assert [got[i].parsed for i in range(1, 7)] == [True, False, False, False, True, True] and got[2].report is None
    one = got[1].report
    assert one.isSchematic and len(one.connections) == 3 and one.grounds == [] and one.summary
    assert not got[5].report.isSchematic and got[5].report.sheet.title == "Untitled sheet" and got[5].report.summary is None
    # A block without an id is met by an end that is missing, not by one that is null; a number isn't its digits.
    assert [(c["from"], c.to) for c in got[6].report.connections] == [("a", "b"), ("a", None), ("7", "a")]
    told = {r.report_id: json.loads(r.j) for r in parsed.where("parsed").select("report_id", sinks.compact_json(F.col("whole")).alias("j")).collect()}
    assert told[5]["extra"] == 1 and told[6]["later"] == {"m": "é"} and told[6]["sheet"] == {"k": {"l": None}} and told[6]["blocks"][2] == {"x": [{"y": 1}]} and told[6]["grounds"] == []
    assert told[6]["connections"] == [{"from": "a", "to": "b", "w": 0.25}, {"from": "a"}, {"from": 7, "to": "a"}] and told[6]["isSchematic"] is True and told[5]["isSchematic"] is False
    again = reports.parse_reports(parsed.where("parsed").select("report_id", F.to_json("whole").alias("json"), F.to_json("whole").alias("before"), F.col("report").alias("was")))
    assert again.where("to_json(whole) <> before OR report <> was").count() == 0
    odd = reports.parse_reports(spark.createDataFrame([('{"blocks":5,"connections":{},"sheet":"s","notes":[1],"summary":3}',), ('{"a":1,"a":2}',), ("{}",), ("",)], "json string")).collect()
    assert [r.parsed for r in odd] == [True, False, True, False] and odd[0].report.blocks == [] and odd[0].report.sheet is None and odd[2].report.sheet.circuitType == "Unknown"
    rails = reports.exploded(parsed.where("parsed"), "powerRails").orderBy("report_id", "pos").collect()
    assert [r.name for r in rails] == ["+12 V", "raw"]
    blocks, edges = (reports.exploded(parsed.where("report_id = 1"), n) for n in ("blocks", "connections"))
    assert reports.pruned_connections(blocks, edges).count() == 3
    names = parsed.where("report_id = 1").select(sinks.sections(F.col("report")).alias("s"), sinks.pretty_json(F.col("whole")).alias("j")).first()
    assert names.s == ["powerRails", "blocks", "notes"] and json.loads(names.j)["sheet"]["title"] == "Bench supply" and '\n  "sheet": {\n    "circuitType"' in names.j


def test_responses_and_history(spark, tmp_path):
    a = json.dumps({"candidates": [{"content": {"parts": [{"text": "{}"}]}}]})
    b = json.dumps({"choices": [{"message": {"content": "<think>x</think> {}"}}]})
    rows = spark.createDataFrame([("a", a), ("b", b), ("a", "bad")], "v string, r string")
    assert [x.t for x in rows.select(reports.answer_text(F.col("v"), F.col("r")).alias("t")).collect()] == ["{}", "{}", None]
    lists = spark.createDataFrame([(json.dumps({"models": [{"name": "models/b", "supportedGenerationMethods": ["generateContent"]}, {"name": "models/a", "supportedGenerationMethods": ["generateContent", "x"]}, {"name": "models/c", "supportedGenerationMethods": []}]}),)], "body string")
    assert [r.model for r in reports.model_names(lists, "a").collect()] == ["a", "b"]
    assert [r.model for r in reports.model_names(spark.createDataFrame([('{"data":[{"id":"z"},{"id":"y"}]}',)], "body string"), "b").collect()] == ["y", "z"]
    stored = spark.createDataFrame([(json.dumps([{"id": "1", "at": 1000, "analysis": {"summary": "s"}}, {"id": "", "analysis": {}}, {"id": "2"}]),), ("junk",)], "json string")
    kept = reports.history(stored)
    assert [(r.id, r.at.timestamp()) for r in kept.collect()] == [("1", 1.0)]
    sinks.append_history(kept.limit(0), kept, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(b"%PDF")
    (tmp_path / "in/b.png").write_bytes(bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    found = files.read_picked(spark, str(tmp_path / "in"))
    assert sorted((r.kind, r.s and tuple(r.s)) for r in found.select("kind", files.png_size().alias("s")).collect()) == [("image", (640, 480)), ("pdf", None)]


def test_gate(spark):
    rows = spark.createDataFrame([("x", 1, False, True), ("x", 2, True, True), ("x", 3, False, True), ("y", 1, None, True), ("y", 2, None, None)], "c string, pos int, emitted boolean, retryable boolean")
    assert {(r.c, r.pos): r.retryable for r in failover.gate_retries(rows, ["c"]).collect()} == {("x", 1): True, ("x", 2): False, ("x", 3): False, ("y", 1): True, ("y", 2): False}


def test_providers(spark):
    from sheetloom.sources.providers import provider

    assert provider("b").id == "b" and provider("zz").id == provider(None).id == "a"
    body = json.dumps({"choices": [{"message": {"content": "<think>x</think>" + json.dumps(demo.REPORT)}}]})
    row = provider("b").analyze(spark.createDataFrame([(body,)], "body string")).first()
    assert row.parsed and row.report.sheet.title == "Bench supply"
    chunks = spark.createDataFrame([("s", 1, "data: " + json.dumps({"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}))], "stream_id string, seq int, chunk string")
    assert provider("a").chat(chunks).first().text == "hi"
