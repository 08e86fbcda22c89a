import pytest
from pyspark.sql import functions as F

from sheetloom.functions import errors, keys, media, text, urls


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("x")).first().x


def s(x):
    return F.lit(x).cast("string")


def test_spaces_and_slashes(one):
    assert one(text.remove_invisible(s(" a​⁠b﻿　c\n d‍"))) == "abcd"
    assert one(text.remove_invisible(s("a\u0085b"))) == "a\u0085b"
    assert one(text.strip_slashes(s(" http://a/b// "))) == "http://a/b"
    assert one(text.strip_slashes(s(None))) == ""


def test_fallbacks(one):
    assert one(text.first_text(s(""), s(None), "Schematic")) == "Schematic" and one(text.first_text(s("a"), s("b"))) == "a"
    assert one(text.first_value(s(None), s(""), "x")) == ""
    assert one(text.join_present(" · ", s("a"), s(""), s(None), s("b"))) == "a · b"


@pytest.mark.parametrize(("n", "label"), [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1535, "1 KB"), (1536, "2 KB"), (1048575, "1024 KB"), (1048576, "1.0 MB"), (1310720, "1.3 MB"), (12 << 20, "12.0 MB")])
def test_human_bytes(one, n, label):
    assert one(text.human_bytes(F.lit(n))) == label


@pytest.mark.parametrize(("word", "colour"), [("Infrared", "#ff6b6b"), ("infra", "#6b4bd6"), ("GREEN/red", "#57cc99"), ("yellow", "#f9c74f"), ("pink", text.NEUTRAL), (None, text.NEUTRAL), ("", text.NEUTRAL)])
def test_colours(one, word, colour):
    assert one(text.colour_of(s(word))) == colour


def test_labels(one):
    assert one(text.truncate_label(s("abcdef"), 6)) == "abcdef" and one(text.truncate_label(s("abcd efgh"), 6)) == "abcd…"
    wrap = lambda x: one(text.wrap_label(s(x)))
    assert wrap("Power supply") == ["Power supply"]
    assert wrap("Switched mode power supply") == ["Switched mode power", "supply"]
    assert wrap("one two three four five six seven eight nine") == ["one two three four", "five six seven…"]
    assert wrap("") == [] and wrap(None) is None


@pytest.mark.parametrize(("said", "left"), [("<think>a</think> b", "b"), ("a <think>b</think>\n\nc", "a c"), ("<think>x</think><think>y</think>z ", "z"), ("a<think>b", "a"), ("a <thi", "a <thi"), ("a</think>b", "a</think>b"), ("\n\n a", "a")])
def test_think(one, said, left):
    assert one(text.strip_thinking(s(said))) == left


def test_dates(one):
    at = lambda t: one(text.relative_date(F.lit(t).cast("timestamp"), F.lit("2024-03-01 08:00:00").cast("timestamp")))
    assert [at("2024-03-01 00:05:00"), at("2024-02-29 13:05:00"), at("2024-01-02 12:00:00"), at("2023-12-31 23:59:00")] == ["Today, 12:05 AM", "Yesterday, 1:05 PM", "Jan 2, 12:00 PM", "Dec 31, 2023, 11:59 PM"]


def test_small_ones(one):
    assert one(text.split_list(s(" a, b\n\nc ,,"))) == ["a", "b", "c"] and one(text.split_list(s(None))) == []
    assert one(text.prompt_with_hint("P", s("  h "))) == "P\n\nh" and one(text.prompt_with_hint("P", s(" "))) == "P"
    assert one(text.chat_role(s("model"))) == "assistant" and one(text.chat_role(s("user"))) == "user"
    assert one(text.data_url(s("data:image/png;x=1;base64,AB\nC"))).asDict() == {"mime_type": "image/png", "base64": "AB\nC"}
    assert one(text.data_url(s("http://a"))) is None
    assert one(text.number_or(s(None))) == 0 and one(text.number_or(s("x"))) is None and one(text.number_or(s("2.5"))) == 2.5


def test_keys(one):
    d = lambda v, k: (r := one(keys.diagnose_key(s(v), s(k)))) and (r.level, r.code)
    assert d("a", "AIza" + "x" * 35) == ("ok", "well-formed") and d("a", "AQ." + "y" * 20) == ("ok", "well-formed")
    assert d("a", "AIza" + "x" * 9) == ("error", "truncated") and d("a", "AIza" + "x" * 40) == ("error", "too-long") and d("a", "zz") == ("warn", "unknown-format")
    assert d("b", "gsk_1") == ("ok", "well-formed") and d("b", "x") == ("error", "wrong-prefix") and d("b", "gsk_1​") == ("warn", "cleaned")
    assert d("a", "") is None and d("a", None) is None and d("c", "x") is None
    assert one(keys.fingerprint(s("abc"))) == "ba7816bf" and one(keys.same_secret(s("a"), s("a"))) and one(keys.same_secret(s("a"), s(None))) is None


def test_errors(one):
    body = lambda m: '{"error":{"message":"%s"}}' % m
    kind = lambda v, n, b: one(errors.classify_error(s(v), F.lit(n), s(b)))
    assert kind("a", 400, body("API key not valid")) == "bad-key" and kind("a", 500, body("model not found")) == "model-gone"
    assert kind("a", 403, "referer") == "key-restricted" and kind("a", 403, None) == "denied" and kind("a", 418, "not found") == "failed"
    assert kind("b", 200, "decommissioned") == "model-gone" and kind("b", 401, "vision") == "bad-key"
    retry = lambda v, n, b: one(errors.retryable(s(v), F.lit(n), s(b)))
    assert retry("a", 400, body("does not support it")) and not retry("a", 400, "does not support it") and retry("b", 400, "vision") and retry("a", 503, None) and not retry("a", 401, None)
    done = lambda n, b: one(errors.key_exhausted(F.lit(n), s(b)))
    assert done(429, None) and done(403, "QUOTA") and done(400, "api_key_invalid") and not done(400, "quota") and not done(401, "quota")
    assert one(errors.vendor_message(s("no json"))) == ""


def test_media(one):
    i = one(media.image_size(F.lit(6144), F.lit(1001)))
    assert (i.scale, i.width, i.height) == (0.5, 3072, 501)
    assert one(media.image_size(F.lit(10), F.lit(5))).scale == 1
    p = one(media.page_size(F.lit(10_000.0), F.lit(0.1), 260))
    assert (p.width, p.height) == (260, 1) and one(media.page_size(F.lit(100), F.lit(50))).width == 3072
    assert one(media.passes_unchanged(F.lit(1.0), F.lit(6 << 20), s("image/png"))) and not one(media.passes_unchanged(F.lit(1.0), F.lit(1), s("image/jpeg")))
    assert one(media.is_pdf(s("A.PDF"))) and one(media.is_pdf(s("x"), s("application/pdf"))) and not one(media.is_pdf(s("x.png"), s(None)))
    assert [one(media.page_jump(s(x), F.lit(9))) for x in ("3", "3.0", "0", "10", "2.5", "x")] == [3, 3, None, None, None, None]
    assert [one(media.page_batch(F.lit(n))) for n in (1, 24, 25)] == [0, 0, 1]


def test_urls(one):
    drop = lambda u: one(urls.drop_parameter(s(u), "key"))
    assert [drop(u) for u in ("h/a?key=1", "h/a?key=1&b=2#f", "h/a?b=2&key=1", "h/a?b=2&key=1&c=3", "h/a?monkey=1", "h/a?key=1#f", "h/a?")] == ["h/a", "h/a?b=2#f", "h/a?b=2", "h/a?b=2&c=3", "h/a?monkey=1", "h/a#f", "h/a?"]
    route = lambda p: tuple(one(urls.route_upstream(s(p))))
    assert [route(p) for p in ("/groq", "/groq/models", "/groqx", "/models")] == [("b", "/"), ("b", "/models"), ("a", "/groqx"), ("a", "/models")]
    assert one(urls.allowed_path(s("a"), s("/models/x-1.5:generateContent"))) and not one(urls.allowed_path(s("a"), s("/models/a/b:generateContent"))) and one(urls.allowed_path(s("b"), s("/chat/completions")))
    assert one(urls.allowed_origin(s("https://a"), s("https://b, https://a"))) and not one(urls.allowed_origin(s("https://a/"), s("https://a")))
    call = lambda k, secret, auth="query": tuple(one(urls.request_url(s(k), s("h"), s("/m"), s(secret), auth)))
    assert call("own", "a b") == ("h/m?key=a+b", None, None) and call("own", "k", "bearer") == ("h/m", "Authorization", "Bearer k")
    assert call("shared", "t") == ("h/m", "X-App-Token", "t") and call("shared", "") == ("h/m", None, None)


def test_credentials(one):
    chain = lambda *a, **k: [tuple(c) for c in one(urls.credential_chain(*map(s, a), **k))]
    assert chain(" k ", "http://c/ ", "t", "http://s", "u", vendor="b", direct="http://d") == [("own", "http://d", "k"), ("custom", "http://c/groq", "t"), ("shared", "http://s/groq", "u")]
    assert chain(None, "", None, "http://s", None) == [("shared", "http://s", None)] and chain("", None, None, "", None) == []
