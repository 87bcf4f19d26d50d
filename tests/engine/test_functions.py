"""Small cases of functions and validations."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import cluster, digest, feed, feedback, vectors


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://Example.COM/Path", "https://example.com/Path"), ("https://a.com/?utm_source=x&id=3&FBCLID=1", "https://a.com/?id=3"), ("https://a.com/p?ref=1#top", "https://a.com/p"),
        ("https://a.com/", "https://a.com"), ("https://a.com/p/", "https://a.com/p/"), ("  not a url ", "not a url"), (None, None), ("https://a.com?x=1", "https://a.com/?x=1"), ("https://a.com/?reference=1", "https://a.com/?reference=1"),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, url, text.canonical_url("v")) == want


def test_texts(spark):
    assert one(spark, "<p>a<b>b</b></p> ", text.strip_html("v")) == "ab"
    assert one(spark, " 1 < 2 ", text.strip_html("v")) == "1 < 2"
    assert one(spark, None, text.strip_html("v")) == ""
    assert one(spark, "short\nmore", text.first_line_title("v")) == "short"
    long = one(spark, "word " * 40, text.first_line_title("v"))
    assert long.endswith("word…") and len(long) <= 121
    assert one(spark, "https://www.x.com/Some_One?x", text.handle("v")) == "Some_One"
    assert one(spark, "https://x.com/search?q", text.handle("v")) is None
    assert one(spark, "https://youtu.be/abcdefghijk", text.youtube_id("v")) == "abcdefghijk"
    assert one(spark, "1. **Hi** [#12](u) there [#3]\nmore", text.summary_preview("v")) == "Hi  there "
    assert one(spark, "see [#12] and [#3](x)", text.linkify("v", "/items/")) == "see [#12](/items/12) and [#3](x)"
    assert one(spark, "<a & 'b'>", text.xml_escape("v")) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, "x]]>y", text.cdata("v")) == "<![CDATA[x]]]]><![CDATA[>y]]>"
    row = text.phrases(spark.createDataFrame([("all is well, truly a game changer here",)], "v string"), "v", ("game changer", "absent")).first()
    assert not row["passed"] and [(h["phrase"], h["at"]) for h in row["hits"]] == [("game changer", 21)]


def test_vectors(spark):
    assert one(spark, "[1, 2.5,-3e1]", vectors.decode_vector("v")) == [1.0, 2.5, -30.0]
    assert one(spark, "[]", vectors.decode_vector("v")) == []
    for bad in ("1,2", "[1,,2]", "[1,2,]", "[NaN]", "[abc]", "[1e999]"):
        with pytest.raises(Exception, match="not a vector"):
            one(spark, bad, vectors.decode_vector("v"))


def test_validation():
    for bad in ({"tier": "x"}, {"limit": 0}, {"limit": 501}, {"hot_hours": 169}, {"date": "1.1.2024"}, {"locale": "de"}):
        with pytest.raises(ValueError):
            feed.FeedQuery(now="2024-01-31", **bad)
    assert feed.tag_list(" a, ,b,") == ("a", "b")
    assert feed.preset(feed.FeedQuery(now="2024-01-31"), "x").source_kind == "x-api"
    with pytest.raises(ValueError):
        feedback.rename_collection("  ")


def test_splits(spark):
    items = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, cluster_id long")
    verdicts = spark.createDataFrame([(1, [3, 4, 99], "x"), (4, [4, 5], "all")], "cluster_id long, rejected array<long>, reason string")
    after, audit = cluster.apply_splits(items, verdicts)
    assert {r["id"]: r["cluster_id"] for r in after.collect()} == {1: 1, 2: 1, 3: None, 4: 4, 5: 4}
    assert [tuple(r) for r in audit.collect()] == [(3, 1, "x")]


def test_survivors(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60)], "cluster_a long, cluster_b long")
    got = {r["cluster_id"]: r["survivor"] for r in cluster.survivors(pairs).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 50}
    after = cluster.apply_merges(spark.createDataFrame([(1, 60), (2, None)], "id long, cluster_id long"), cluster.survivors(pairs))
    assert {r["id"]: r["cluster_id"] for r in after.collect()} == {1: 50, 2: None}


def test_windows_and_lanes(spark):
    start, end = digest.day_window("2024-04-25 10:30:45")
    row = spark.range(1).select(start.cast("string"), end.cast("string")).first()
    assert tuple(row) == ("2024-04-24 10:00:00", "2024-04-25 10:00:00")
    got = cluster.orchestrate([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 3)])
    assert [(n, r, bool(e)) for n, r, e in got] == [("a", 1, False), ("b", None, True), ("c", 3, False)]
    assert spark.range(1).select(F.lit(1)).count() == 1
