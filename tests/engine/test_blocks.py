"""The main block of pages without a marked article."""

import html
import re

from pyspark.sql import functions as F

from tidewire.functions import content
from tidewire.functions.batches import ARROW_ROWS
from tidewire.functions.blocks import main_text
from tidewire.plans.registry import QUERIES

LONG = "This sentence is long enough to count as a block of text in a page."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">A link of the menu with quite a long title {i}</a></li>' for i in range(9)) + "</ul>"


def paragraphs(page):
    return [html.unescape(p) for p in re.findall(r"<p>(.*?)</p>", main_text(page) or "")]


def test_text_beats_links():
    page = f"<html><body><div>{MENU}</div><div id=a><h1>A title</h1><p>{LONG} 1</p><div><p>{LONG} 2</p></div></div><div><p>Short.</p></div></body></html>"
    assert paragraphs(page) == ["A title", f"{LONG} 1", f"{LONG} 2"]


def test_rows_of_a_table_and_neighbours():
    assert paragraphs(f"<table><tr><td>{MENU}</td><td><p>{LONG}<p>{LONG} again</td></tr></table>") == [LONG, f"{LONG} again"]
    # an article cut in two blocks side by side; a box with little text isn't part of it
    page = f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG} b</p></div><div>A little box</div></div></body>"
    assert paragraphs(page) == [LONG, LONG, f"{LONG} b"]


def test_odd_pages():
    assert main_text(None) is None and main_text("") is None and main_text("<p>short</p>") is None
    assert main_text(f"<body><nav><p>{LONG}</p></nav><script>var x = '{LONG}';</script></body>") is None
    assert paragraphs(f"</div></p>{LONG} &lt;b&gt; &amp;amp; <b>bold") == [f"{LONG} <b> &amp; bold"]
    assert paragraphs("<div>" * 5000 + LONG) == [LONG]
    assert paragraphs(f"<div><p>{LONG}</p><p><a href=x>{LONG}</a></p></div>") == [LONG]  # a block of links goes
    assert len(paragraphs(f"<div>{f'<p>{LONG}</p>' * 20000}</div>")) == 20000


def test_same_as_the_marked_article(spark, sf_dir):
    """Pages whose article isn't marked give what the mark would have given, in 95 of 100 of those with 200 characters and more. Where an
    article is as short as the box beside it, density can't tell them apart: over all pages it is 0.9."""
    marked = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", content.readable("html").alias("r")).select("page_id", F.col("r.body").alias("want"))
    both = QUERIES["readable_blocks"](spark, sf_dir).join(marked, "page_id")
    squeeze = lambda c: F.regexp_replace(c, r"\s+", "")
    both = both.select((squeeze("body") == squeeze("want")).alias("same"), (F.length("want") >= 200).alias("long"))
    n, same, long, same_long = both.agg(F.count("*"), F.count_if("same"), F.count_if("long"), F.count_if(F.col("same") & F.col("long"))).head()
    assert n == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert long and same_long >= 0.95 * long and same >= 0.9 * n, (same, n, same_long, long)


def test_readable_falls_back(spark):
    rows = [(1, f"<body><div>{MENU}</div><div><p>{LONG}</p><p>{LONG} &amp; more</p></div></body>"), (2, "<body><p>tiny</p></body>"), (3, None), (4, f"<article><p>a</p></article><div>{LONG}</div>"), (5, "")]
    got = {r["n"]: r["r"] for r in spark.createDataFrame(rows, "n long, html string").select("n", content.readable("html").alias("r")).collect()}
    assert got[1]["body"] == f"{LONG}\n{LONG} & more" and got[1]["excerpt"] == LONG
    assert [got[k]["body"] for k in (2, 3, 4, 5)] == ["tiny", "", "a", ""]


def test_pages_go_through_python_once(spark, sf_dir):
    """One step of Python: chained ones are two workers for each core, and each holds its own batch of whole pages. Batches are small."""
    plan = QUERIES["readable_blocks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    assert int(spark.conf.get(ARROW_ROWS)) <= 1000


def test_bare_references_in_a_body(spark):
    assert spark.createDataFrame([("<article><p>&copy 2024 a &amp b &#65</p></article>",)], "html string").select(content.readable("html")["body"]).first()[0] == "© 2024 a & b A"
