import json
import random
import re
import time

from hypothesis import example, given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetloom.functions import text
from sheetloom.plans.records import _cut
from sheetloom.sources.demo import ANSWER, answer_chunks
from sheetloom.sources.latest import LatestTable
from sheetloom.streaming import quota, sse
from sheetloom.streaming.runs import ROCKSDB, drain
from sheetloom.streaming.think import ThinkStripper


def cuts(s, at):
    at = sorted({0, len(s), *(a % (len(s) + 1) for a in at)})
    return [s[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


PIECES = st.lists(st.sampled_from(["<think>", "</think>", "<thi", "nk>", "a", " ", "\n", "<", "/", "b c"]), max_size=14).map("".join)


@given(PIECES, st.lists(st.integers(0, 100), max_size=20))
def test_stripping_does_not_depend_on_the_cuts(s, at):
    whole, parts = ThinkStripper(), ThinkStripper()
    assert "".join(parts.push(c) for c in cuts(s, at)) + parts.flush() == whole.push(s) + whole.flush()


@given(PIECES)
@example("<thi<think></think>nk>")
@example("a <think>b</think> \n<think>c</think> d </think> <think>e")
def test_little_is_held_back_and_blocks_are_removed_once(s):
    """Halves of a tag that meet where a block stood are text, as in X17: blocks are removed in one pass."""
    want = re.sub(r"<think>.*?(</think>\s*|\Z)", "", s, flags=re.DOTALL).lstrip()
    f, shown = ThinkStripper(), ""
    for c in s:
        shown += f.push(c)
        assert len(f.held) <= 7 and ("<think>" + "</think>").find(f.held) >= 0
        assert want.startswith(shown)
    assert shown + f.flush() == want


def test_stripping_in_chunks_equals_the_column(spark):
    dice = random.Random(2)
    texts = ["".join(dice.choice(["<think>", "</think>", "<thi", "a", " ", "\n", "b"]) for _ in range(9)) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.strip_thinking(F.col("t")).alias("x")).collect()
    for r in rows:
        f = ThinkStripper()
        assert (f.push(r.t) + f.flush()).strip() == r.x


def stream(vendor):
    if vendor == "b":
        events = [{"choices": [{"delta": {"content": c}}]} for c in ("<thi", "nk>no</think>\n", "Hello ", "wörld")] + [{"choices": []}]
    else:
        events = [{"candidates": [{"content": {"parts": [{"text": "no", "thought": True}, {"text": c}]}}]} for c in ("Hello ", "wörld")] + [{"candidates": [{"finishReason": "STOP"}]}]
    lines = [f"data: {json.dumps(e)}" for e in events] + [": comment", "data: {broken", "data: [DONE]"]
    return "\r\n\r\n".join(lines[:2]) + "\r\n\r\n" + "\n\n".join(lines[2:])


@given(st.sampled_from("ab"), st.lists(st.integers(0, 1000), max_size=30))
def test_live_decoding_does_not_depend_on_the_cuts(vendor, at):
    d = sse.EventDecoder(vendor)
    assert ("".join(d.push(c) for c in cuts(stream(vendor), at)) + d.flush()).strip() == "Hello wörld"


def test_batch_decoding(spark):
    for vendor in "ab":
        s = stream(vendor)
        chunks = [(vendor, i, s[i : i + 7]) for i in range(0, len(s), 7)]
        random.Random(1).shuffle(chunks)
        frame = spark.createDataFrame(chunks, "stream_id string, seq int, chunk string")
        assert sse.decode_chunks(frame, vendor=vendor).first().text == "Hello wörld"
    assert "".join(answer_chunks()) == ANSWER


def test_live_streams(spark, tmp_path):
    s = stream("b")
    (tmp_path / "in").mkdir()
    schema = "stream_id string, seq long, chunk string, last boolean"
    parts = [s[:20], s[20:70], s[70:]]
    for i, p in enumerate(parts):
        rows = [{"stream_id": x, "seq": i, "chunk": p, "last": i == len(parts) - 1} for x in ("x", "y")]
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)))
        time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = sse.decode_live(source, "b").writeStream.format("memory").queryName("said").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    until = time.time() + 150
    while spark.table("said").count() < 6 and time.time() < until and query.isActive:  # the timeouts of state keep it running
        time.sleep(0.5)
    query.stop()
    for x in ("x", "y"):
        rows = spark.table("said").where(F.col("stream_id") == x).orderBy("seq").collect()
        assert "".join(r.text for r in rows) == "Hello wörld" and [r.ended for r in rows] == [False, False, True]


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(map(json.dumps, rows)))


def test_live_quota(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"who": "u", "ts": f"2024-01-01T0{i}:00:00Z"} for i in range(5)] + [{"who": "u", "ts": "2024-01-02T00:00:00Z"}])
    source = spark.readStream.schema("who string, ts timestamp").json(str(tmp_path / "in"))
    table = LatestTable(spark, str(tmp_path / "out"), ["who", "day"], "requests", "who string, day date, requests long, used long", buckets=2)
    for _ in range(2):
        quota.publish_latest(quota.live_daily_usage(source, "who", "ts", cap=3), table, str(tmp_path / "c"))
    assert {str(r.day): (r.requests, r.used) for r in table.read().collect()} == {"2024-01-01": (5, 3), "2024-01-02": (1, 1)}
    put(tmp_path / "in", "b.json", [{"who": "u", "ts": "2024-01-02T01:00:00Z"}])
    quota.publish_latest(quota.live_daily_usage(source, "who", "ts", cap=3), table, str(tmp_path / "c"))
    assert {str(r.day): (r.requests, r.used) for r in table.read().collect()} == {"2024-01-01": (5, 3), "2024-01-02": (2, 2)}


CHUNKS = "stream_id string, seq long, chunk string, last boolean"


def told(spark, tmp_path, timeout_ms=600_000):
    """Run over what has arrived in tmp_path/in; what each stream has told so far, with the number of its ends."""
    source = spark.readStream.schema(CHUNKS).json(str(tmp_path / "in"))
    drain(sse.decode_live(source, "b", timeout_ms), str(tmp_path / "c"), str(tmp_path / "out"))
    rows = spark.read.schema("stream_id string, seq long, text string, ended boolean").parquet(str(tmp_path / "out")).collect()
    return {x: ("".join(r.text for r in sorted(rows, key=lambda r: r.seq) if r.stream_id == x), sum(r.ended for r in rows if r.stream_id == x)) for x in {r.stream_id for r in rows}}


def test_chunks_wait_for_their_turn_over_restarts(spark, tmp_path):
    s = stream("b")
    row = lambda i: {"stream_id": "x", "seq": i, "chunk": s[i * 40 : i * 40 + 40], "last": (i + 1) * 40 >= len(s)}
    n = -(-len(s) // 40)
    put(tmp_path / "in", "a.json", [row(i) for i in range(2, n)])
    assert told(spark, tmp_path) == {}
    put(tmp_path / "in", "b.json", [row(0), row(3)])
    assert told(spark, tmp_path)["x"][1] == 0
    put(tmp_path / "in", "c.json", [row(1), row(1), {**row(2), "chunk": "repeats with other text count for nothing"}])
    assert told(spark, tmp_path) == {"x": ("Hello wörld", 1)}
    put(tmp_path / "in", "d.json", [row(0), row(n - 1)])
    assert told(spark, tmp_path) == {"x": ("Hello wörld", 1)}


def test_a_gap_that_stays_ends_a_stream(spark, tmp_path):
    event = lambda c: 'data: {"choices":[{"delta":{"content":"' + c + '"}}]}\n\n'
    put(tmp_path / "in", "a.json", [{"stream_id": "x", "seq": i, "chunk": event(c), "last": i == 4} for i, c in ((0, "a"), (2, "c"), (4, "e"))])
    assert told(spark, tmp_path, 500) == {"x": ("a", 0)}
    time.sleep(1)
    put(tmp_path / "in", "b.json", [{"stream_id": "y", "seq": 0, "chunk": event("y"), "last": True}])
    assert told(spark, tmp_path, 500) == {"x": ("ace", 1), "y": ("y", 1)}


def test_streams_of_a_group_have_timeouts_of_their_own(spark, tmp_path):
    """Many streams share a value of the state. One that is silent ends while others of its group go on; those that are known still are."""
    def told(timeout_ms):
        source = spark.readStream.schema(CHUNKS).json(str(tmp_path / "in"))
        drain(sse.decode_live(source, "b", timeout_ms, groups=1), str(tmp_path / "c"), str(tmp_path / "out"))
        rows = spark.read.schema("stream_id string, seq long, text string, ended boolean").parquet(str(tmp_path / "out")).collect()
        return {x: [(r.seq, r.text, r.ended) for r in sorted(rows, key=lambda r: r.seq) if r.stream_id == x] for x in {r.stream_id for r in rows}}

    event = lambda c: 'data: {"choices":[{"delta":{"content":"' + c + '"}}]}\n\n'
    row = lambda x, i, c, last=False: {"stream_id": x, "seq": i, "chunk": event(c), "last": last}
    names = [None, *(f"s{i}" for i in range(40))]
    put(tmp_path / "in", "a.json", [r for x in names for r in (row(x, 0, "a"), row(x, 2, "c"), row(x, None, "without number"))])
    assert told(1500) == {x: [(0, "a", False)] for x in names}
    assert spark.read.format("statestore").load(str(tmp_path / "c")).count() == 1
    time.sleep(2)
    put(tmp_path / "in", "b.json", [row("s0", 1, "b"), row("new", 0, "n", True)])
    late = {x: [(0, "a", False), (2, "c", False), (3, "", True)] for x in names if x != "s0"}
    assert told(60_000) == late | {"s0": [(0, "a", False), (1, "b", False), (2, "c", False)], "new": [(0, "n", True)]}
    put(tmp_path / "in", "c.json", [row("new", 0, "repeated", True), row("s0", 3, "d", True)])
    assert told(60_000)["s0"][3:] == [(3, "d", True)] and told(60_000)["new"] == [(0, "n", True)]


def test_long_streams_are_cut_in_one_pass(spark):
    """With a substring for each chunk, whose start is counted from the stream's, this took 200,000 times two million characters."""
    began = time.time()
    whole = spark.range(1).select(F.lit("x").alias("stream_id"), F.repeat(F.lit("a\né\U0001f600\r"), 400_000).alias("whole"), F.lit(10).alias("size"))
    r = _cut(whole).agg(F.count("seq"), F.max("seq"), F.count_if("last"), F.max(F.when(F.col("last"), F.col("seq"))), F.min("chunk"), F.max("chunk")).first()
    assert tuple(r) == (200_000, 199_999, 1, 199_999, "a\né\U0001f600\r" * 2, "a\né\U0001f600\r" * 2) and time.time() - began < 60
    odd = spark.createDataFrame([("a", "abcde", 2), ("b", None, 2), ("c", "abcd", 2), ("d", "x", 9)], "stream_id string, whole string, size int")
    assert sorted(map(tuple, _cut(odd).collect())) == [("a", 0, "ab", False), ("a", 1, "cd", False), ("a", 2, "e", True), ("c", 0, "ab", False), ("c", 1, "cd", True), ("d", 0, "x", True)]


def test_live_admission_forgets_after_its_time(spark, tmp_path):
    def admitted():
        source = spark.readStream.schema("who string, ts timestamp, id long").json(str(tmp_path / "in"))
        drain(quota.live_admission(source, "who", "ts", "id", cap=2, kept_ms=3000), str(tmp_path / "c"), str(tmp_path / "out"), store=ROCKSDB)
        return {r.request: (r.allowed, r.used, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    ask = lambda *ids: [{"who": None if i > 90 else "u", "ts": f"2024-01-01T00:00:{i:02d}Z" if i < 90 else "2024-01-01T00:00:00Z", "id": i} for i in ids]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    put(tmp_path / "in", "a.json", ask(3, 1, 2, 91))
    assert admitted() == {1: (True, 1, 1), 2: (True, 2, 0), 3: (False, 2, 0), 91: (True, 1, 1)}
    time.sleep(3.5)
    put(tmp_path / "in", "b.json", ask(4))
    assert admitted()[4] == (True, 1, 1)  # the counter was gone
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_live_admission_of_callers_with_many_days(spark, tmp_path):
    """A caller's days have counters of their own, over restarts; requests without number or time are told too."""
    def admitted():
        source = spark.readStream.schema("who string, ts timestamp, id long").json(str(tmp_path / "in"))
        drain(quota.live_admission(source, "who", "ts", "id", cap=2), str(tmp_path / "c"), str(tmp_path / "out"), store=ROCKSDB, partitions=2)
        return sorted((r.day or "", -1 if r.request is None else r.request, r.allowed, r.used, r.remaining) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    ask = lambda day, *ids: [{"who": "u", "ts": day and f"2024-01-{day:02d}T00:00:00Z", "id": i} for i in ids]
    put(tmp_path / "in", "a.json", [*ask(1, 2**60 + 1), *ask(2, 7, None, 5), *ask(None, 8, None)])
    first = [("", -1, True, 1, 1), ("", 8, True, 2, 0), ("2024-01-01", 2**60 + 1, True, 1, 1), ("2024-01-02", -1, True, 1, 1), ("2024-01-02", 5, True, 2, 0), ("2024-01-02", 7, False, 2, 0)]
    assert admitted() == first
    put(tmp_path / "in", "b.json", [*ask(1, 3, 4), *ask(3, 1)])
    assert admitted() == sorted([*first, ("2024-01-01", 3, True, 2, 0), ("2024-01-01", 4, False, 2, 0), ("2024-01-03", 1, True, 1, 1)])


def test_latest_table(spark, tmp_path):
    table = LatestTable(spark, str(tmp_path), ["k"], "n", "k string, n long, v string", buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "k string, n long, v string")
    now = lambda version=None: {r.k: (r.n, r.v) for r in table.read(version).collect()}
    assert now() == {}
    table.upsert(rows(("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), (None, 1, "none")), 0)
    assert now() == {"a": (2, "y"), "b": (1, "x"), None: (1, "none")}
    table.upsert(rows(("a", 1, "old"), ("b", 1, "tie"), ("c", 5, None)), 1)
    assert now() == {"a": (2, "y"), "b": (1, "tie"), "c": (5, None), None: (1, "none")} and now(0)["b"] == (1, "x")
    table.upsert(rows(("a", 9, "again")), 1)  # a batch that was committed
    # A batch that failed half-way left parts, but no marker.
    rows(("a", 99, "lost")).write.parquet(f"{tmp_path}/parts/version=2/bucket=0")
    assert now()["a"] == (2, "y")
    table.upsert(rows(("d", 1, "new")), 2)
    assert now() == {"a": (2, "y"), "b": (1, "tie"), "c": (5, None), "d": (1, "new"), None: (1, "none")}
    for i in range(3, 9):
        table.upsert(rows(("d", i, "new")), i)
    assert len(table.versions()) == 3 and table.read().count() == 5 and now()["d"] == (8, "new")
    assert sum(1 for _ in tmp_path.glob("parts/version=*/bucket=*/*.parquet")) <= 4 + 3
