"""Parsers, normalising and writing: what the registered queries don't reach."""

import random
from html import unescape
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tidewire.functions import content
from tidewire.operators import detail, normalize
from tidewire.plans.registry import QUERIES
from tidewire.sources import feeds, shared, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_unknown_root_is_an_error(spark):
    rows = spark.createDataFrame([(1, "<html><body/></html>")], "n int, payload string")
    assert feeds.parse_feed(rows, strict=False).count() == 0
    with pytest.raises(Exception, match="neither RSS"):
        feeds.parse_feed(rows).collect()
    assert feeds.parse_feed(rows.limit(0)).count() == 0


def test_single_entries_and_empty_feeds(spark):
    docs = ["<rss><channel></channel></rss>", "<feed/>", "<rss><channel><item><link>u</link></item></channel></rss>", '<!-- a --><feed><entry><link href="v"/></entry></feed>']
    got = feeds.parse_feed(spark.createDataFrame(list(enumerate(docs)), "n int, payload string")).collect()
    assert sorted((r["n"], r["external_id"], r["title"]) for r in got) == [(2, "u", "(untitled)"), (3, "v", "(untitled)")]


@pytest.mark.parametrize(("text", "want"), [("Tue, 30 Jan 2024 10:00:00 GMT", "2024-01-30 10:00:00"), ("30 Jan 2024 10:00:00 +0800", "2024-01-30 02:00:00"), ("2024-01-30T10:00:00-01:00", "2024-01-30 11:00:00"), ("2024-01-30", "2024-01-30 00:00:00"), ("soon", None), ("", None)])
def test_dates(spark, text, want):
    assert one(spark, F.date_format(feeds.parse_date(F.col("t")), "yyyy-MM-dd HH:mm:ss"), t=text) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("Anthropic 发布了 Claude Design", "Anthropic 发布了 Claude Design"), ("line one\n\nline two", "line one\n\nline two"), ("<p>Hello <strong>world</strong></p>", "Hello world"), ("<p>a</p><p>b</p>", "ab"), ("", ""), ("   ", ""),
        ("<not-a-real-tag>text</>", "text"), ("<p>a &amp; b &#233; &#x1F600; &lt;i&gt; &unknown; &amp;lt; &nbsp;</p>", "a & b é 😀 <i> &unknown; &lt;"), ("a &amp; b", "a &amp; b"), ("<!-- x > y --><b>z</b>", "z"), ("<br>", ""), ("3 < 4", "3 < 4"),
    ],
)
def test_strip_markup(spark, html, want):
    assert one(spark, content.strip_markup("t"), t=html) == want


@pytest.mark.parametrize(
    ("raw", "text", "attribute"),
    [
        ("AT&T &amp; co", "AT&T & co", "AT&T & co"), ("&check;&NotEqualTilde;&hearts;", "✓≂̸♥", "✓≂̸♥"), ("a&ltb &copy 1", "a<b © 1", "a&ltb © 1"), ("?a=1&copy=2&notit;", "?a=1©=2¬it;", "?a=1&copy=2&notit;"), ("&#128;&#xD800;&#65 &#x41;", "€�A A", "€�A A"), ("&", "&", "&"), ("", "", ""), (None, None, None),
    ],
)
def test_references(spark, raw, text, attribute):
    assert (one(spark, content.decode_entities(F.col("t")), t=raw), one(spark, content.decode_entities(F.col("t"), True), t=raw)) == (text, attribute)


@pytest.mark.parametrize(("html", "want"), [("<title>a&amp</title><p>p{}</p>", "a&ampp{}"), ("<i>a&am</i>p{}", "a&amp{}"), ("<b>a &amp; &copy 1 &#65 &#65;</b>", "a & &copy 1 &#65 A")])
def test_references_at_a_tag(spark, html, want):
    """A reference cut off by a tag doesn't take the letters behind the tag for its name."""
    assert one(spark, content.strip_markup("t"), t=html) == want


def test_references_as_the_standard_library(spark):
    rng = random.Random(1)
    names = sorted(html5)
    texts = ["&" + n for n in names] + [f"&{n}z=1" for n in names] + [f"&#{n};&#x{n:x}" for n in (*range(0x120), 0xD800, 0xFDD0, 0xFEFF, 0xFFFE, 0x10FFFF, 0x110000, 10**30)]
    texts += ["".join(rng.choice([f"&{rng.choice(names)}", "&", "#", "x", ";", "=", "é", "\n", "not", "&#", "&#0065", "&;"]) for _ in range(6)) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", content.decode_entities(F.col("t")).alias("d")).collect()
    assert [r["t"] for r in got if r["d"] != unescape(r["t"])] == []


def test_normalize_computes_the_hash_twice_at_most(spark, sf_dir):
    """Once where hashes are counted, once where rows get their outcome; and no text goes through Python."""
    plan = QUERIES["normalize_outcomes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and "EvalPython" not in plan


@pytest.mark.parametrize(
    ("payload", "want"),
    [('{"content:encoded":"<b>x</b>","content":"y"}', "<b>x</b>"), ('{"content:encoded":"","description":{"#text":"d"}}', "d"), ('{"content":{"other":1},"summary":"s"}', "s"), ("{}", ""), ("no json", ""), (None, "")],
)
def test_payload_body(spark, payload, want):
    assert one(spark, content.payload_body("t"), t=payload) == want


def test_normalize_known_and_empty(spark):
    schema = "id long, source_id string, url string, title string, published_at timestamp_ntz, payload string"
    raw = spark.createDataFrame([(1, "s", "https://A.example/?utm_source=x", None, None, '{"content":"b"}'), (2, "s", "https://a.example/", " ", None, '{"content":"b"}'), (3, "s", " ", "t", None, "{}"), (4, "s", "https://b.example/", "t", None, None)], schema)
    rows = {r["id"]: r for r in normalize.normalize(raw, "2024-01-31").collect()}
    assert [rows[k]["outcome"] for k in (1, 2, 3, 4)] == ["created", "deduped", "skipped", "created"]
    assert rows[1]["title"] == "(untitled)" and str(rows[1]["published_at"]) == "2024-01-31 00:00:00"
    known = normalize.normalize(raw.where("id = 4"), "2024-01-31").select("content_hash")
    assert {r["id"]: r["outcome"] for r in normalize.normalize(raw, "2024-01-31", known).collect()}[4] == "deduped"
    assert normalize.normalize(raw.limit(0), "2024-01-31").count() == 0


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, name string, n int")
    got = sinks.upserted(table, spark.createDataFrame([(2, 1), (3, 2)], "k int, n int"), "k", rules={"n": F.coalesce("old_n", F.lit(0)) + F.col("new_n")})
    assert sorted(map(tuple, got.collect())) == [(1, "a", 5), (2, "b", 7), (3, None, 2)]


def test_append_unseen(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert sinks.append_unseen(rows, path, "a", "b") == 2
    assert sinks.append_unseen(rows, path, "a", "b") == 0
    assert sinks.append_unseen(rows.limit(0), path, "a", "b") == 0


def test_detail_ids(spark):
    items = spark.createDataFrame([], "id long, source_id string, title string, title_zh string, title_en string, summary_zh string, summary_en string, capabilities array<string>, entities array<string>, topics array<string>, importance int, tier string, published_at timestamp_ntz, url string, editor_note_zh string, editor_note_en string, body_md string, enriched_at timestamp_ntz")
    sources = spark.createDataFrame([], "id string, name_en string, name_zh string, kind string, grp string, locale string")
    for bad in (0, -1, "7", True, 1.5):
        assert detail.detail(items, sources, bad).count() == 0


def test_shared_dir_needs_a_setting(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Elsewhere)


@pytest.mark.parametrize(("ip", "want"), [("10.0.0.1", True), ("172.31.255.255", True), ("172.32.0.1", False), ("8.8.8.8", False), ("::1", True), ("FD00::1", True), ("feb0::1", True), ("::ffff:127.0.0.1", True), ("::ffff:8.8.8.8", False), ("256.1.1.1", False), ("example.org", False), ("", False), (None, False)])
def test_private_address(spark, ip, want):
    assert one(spark, content.private_address("t"), t=ip) is want
