"""Pins of the scalar functions, one query per group of cases."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import ids, text, values, web
from marginalia.functions.stopwords import CLOUD_EN


def apply(spark, cases, make):
    """Value of ``make(column)`` for every case."""
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, x string")
    found = rows.select("n", make(F.col("x")).alias("y")).orderBy("n").collect()
    return [r["y"] for r in found]


def test_stem(spark):
    pairs = {
        "running": "runn", "stories": "story", "boxes": "box", "shoes": "sho", "walked": "walk", "cats": "cat",
        "cat": "cat", "run": "run", "glass": "glass", "search": "search", "sing": "sing", "dies": "die", "bus": "bus",
    }
    assert apply(spark, pairs, lambda x: text.stem("x")) == list(pairs.values())


def test_legacy_tokens(spark):
    cases = ["the quick brown fox 123 a of it", "running studies", "說明一下", "hello,world!", "Don't stop", ""]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, x string")
    pieces = rows.select("n", F.posexplode(text.legacy_pieces(F.col("x"))).alias("p", "piece"))
    tokens = pieces.select("n", "p", text.legacy_tokens("piece").alias("t")).orderBy("n", "p").collect()
    found = [[t for r in tokens if r["n"] == n for t in r["t"]] for n in range(len(cases))]
    assert found == [["quick", "brown", "fox"], ["runn", "study"], ["說明", "明一", "一下"], ["hello", "world"], ["don", "stop"], []]


def test_words(spark):
    cases = ["Don't stop state-of-the-art", "AI with Google's 3.14 a_b", "çà et là", "x1y2 example.com.", "深度學習AI", "日本語のテキスト", ""]
    assert apply(spark, cases, lambda x: text.words(F.lower(x))) == [
        ["don't", "stop", "state", "of", "the", "art"],
        ["ai", "with", "google's", "3.14", "a_b"],
        ["çà", "et", "là"],
        ["x1y2", "example.com"],
        ["深度", "度學", "學習", "ai"],
        ["日本", "本語", "語の", "のテ", "テキ", "キス", "スト"],
        [],
    ]


def test_very_long_words(spark):
    lengths = apply(spark, ["a1" * 200_000, "é" * 300_000, "." * 100_000], lambda x: F.size(text.words(x)))
    assert lengths == [1, 1, 0]


def test_terms(spark):
    cases = ["google", "don't", "time", "2024", "a", "running", "là", "的", "沒有", "深度", "です"]
    assert apply(spark, cases, lambda x: text.term("x", "'en'")) == [
        "google", None, "time", None, None, "runn", "là", None, None, "深度", "です",
    ]
    assert apply(spark, ["time", "です", "沒有"], lambda x: text.term("x", "'ja'", CLOUD_EN)) == [None, None, None]


def test_possessive(spark):
    assert apply(spark, ["google's", "its", "'s"], lambda x: text.without_possessive("x")) == ["google", "its", ""]


def test_language(spark):
    cases = ["你好世界", "こんにちは", "你好世", "こんに", "你好世界 こんにちは", "", None, "plain", "ça"]
    assert apply(spark, cases, text.detect_language) == ["zh", "ja", "en", "en", "ja", "en", "en", "en", "en"]


def test_domain(spark):
    cases = {
        "https://www.example.com/a": "example.com", "https://sub.www.example.com/a": "sub.www.example.com",
        "http://www2.example.com/a": "www2.example.com", "mailto:a@b.com": "", "https://": "bad", "::::": "bad",
        "HTTP://User:Pw@Example.COM:8080/x?y": "example.com", "not a url": "bad", "#": "bad", "http://[::1]/": "[::1]",
        "https:example.org": "example.org", "http://a b/": "bad", "file:///x": "", None: "bad",
    }
    assert apply(spark, cases, lambda x: web.domain(x, "bad")) == list(cases.values())


def test_web_text(spark):
    assert apply(spark, ["https://a.com/x", "ftp://a.com", "javascript:x", "", "HTTPS://A.com"], web.safe_url) == [
        "https://a.com/x", "", "", "", "HTTPS://A.com",
    ]
    assert apply(spark, ["<a href=\"x\">&'", "", None], web.escape_html) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;", "", ""]
    cases = ["=SUM(1,2)", "+2+5", "-1+1", "@SUM(A1)", "\tx", "\rx", "note: =SUM(1)", ""]
    assert apply(spark, cases, web.harden_cell) == ["'" + c for c in cases[:6]] + ["note: =SUM(1)", ""]


def plain_fnv(salt, url):
    state = 0xCBF29CE484222325
    data = f"{salt}\0{url}".encode("utf-16-be")
    for i in range(0, len(data), 2):
        state = ((state ^ int.from_bytes(data[i : i + 2], "big")) * 0x100000001B3) % 2**64
    return f"gen_{state:016x}"


def test_stable_id(spark):
    urls = ["https://example.com/a", "https://example.com/😀", "x" * 400, ""]
    found = apply(spark, urls, lambda x: ids.stable_id(x, F.lit("f1")))
    assert found == [plain_fnv("f1", u) for u in urls]
    assert found[0] == "gen_7e8250e1803c465c"


def test_small_values(spark):
    stamps = ["2024-03-05T07:08:09.000Z", "", None, "soon"]
    assert apply(spark, stamps, values.deleted_at_label) == ["2024/3/5 07:08:09", "unknown", "unknown", "soon"]
    assert apply(spark, ["a" * 10, "a" * 11], values.node_label) == ["a" * 10, "a" * 10 + "..."]
    row = spark.range(1).select(
        *[values.node_radius(F.lit(d)) for d in (0, 4, 100)],
        *[values.node_label_offset(F.lit(d)) for d in (0, 4)],
        values.percent(F.lit(0.125)), values.round_half_up(F.lit(-1.5)), values.sigmoid(F.lit(0.0)),
        *[values.blend_mode(F.lit(x)) for x in (0.2, 0.5, 0.8)], *[values.link_width(F.lit(w)) for w in (0.5, 9.0)],
    ).first()
    assert list(row) == [8.0, 12.0, 44.0, 10.0, 14.0, 13, -1, 0.5, "tf", "blend", "tfidf", 1.0, 4.0]


@pytest.mark.parametrize(
    "kind, value, missing",
    [(T.StringType(), "''", True), (T.StringType(), "'0'", False), (T.LongType(), "0L", True), (T.BooleanType(), "false", True),
     (T.BooleanType(), "true", False), (T.DoubleType(), "1.5D", False)],
)
def test_missing_values(spark, kind, value, missing):
    row = spark.range(1).select(values.truthy_or_null(F.expr(value), kind).isNull()).first()
    assert row[0] is missing


def test_number_text(spark):
    row = spark.range(1).select(values.as_text(F.lit(7.0), T.DoubleType()), values.as_text(F.lit(7.5), T.DoubleType())).first()
    assert list(row) == ["7", "7.5"]
