"""String, URL, hash and markup functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only track, by name, in any case; and the beginning that marks more of them.
TRACKING = ("fbclid", "gclid", "ref", "ref_src", "mc_c", "mc_q", "_hsenc", "_hsmi", "igshid", "mkt_tok", "vero_id")
TRACKING_PATTERN = r"^(utm_[^=]*|" + "|".join(TRACKING) + r")(=.*)?$"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once for each row: Spark repeats an expression wherever it stands in a CASE. No Python functions within `of`."""
    return F.element_at(F.transform(F.array(value), of), 1)


def canonical_url(url: str) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no slash behind a bare host; what is no URL is trimmed."""

    def of(text: Column) -> Column:
        take = lambda k: F.regexp_extract(text, _URL, k)
        kept = F.array_join(F.filter(F.split(F.substring(take(4), 2, 1 << 20), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING_PATTERN)), "&")
        query = let(kept, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        path = lambda p, q: F.when((p == "") & (q != ""), "/").when((p == "/") & (q == ""), "").otherwise(p)
        behind = let(query, lambda q: F.concat(let(take(3), lambda p: path(p, q)), q))
        return F.when(text.rlike(_URL), F.concat(F.lower(take(1)), F.lit("://"), F.lower(take(2)), behind)).otherwise(text)

    return let(F.trim(F.col(url)), of)


def strip_html(html: str) -> Column:
    """Text without tags; text that has no tag marker only trimmed. Entities stay as they are."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"^\s+|\s+$", "")
    return F.when(text.rlike("<[a-zA-Z!/]"), F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"^\s+|\s+$", "")).otherwise(text)


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n\n"), body), 256)


def first_line_title(text: str) -> Column:
    """First line, at most 120 characters, cut at the last blank beyond 60, with an ellipsis where cut."""
    line = F.trim(F.regexp_replace(F.substring_index(F.col(text), "\n", 1), r"\r$", ""))
    cut = F.left(line, F.lit(120))
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    has = F.instr(cut, " ") > 0
    return F.when(F.length(line) <= 120, line).otherwise(F.concat(F.when(has & (last > 60), F.left(cut, last)).otherwise(cut), F.lit("…")))


def handle(url: str) -> Column:
    """The account named by a profile URL, or null."""
    got = F.regexp_extract(url, r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/(?!home|i/|search)([A-Za-z0-9_]{1,15})(?:[/?#]|$)", 1)
    return F.nullif(got, F.lit(""))


def youtube_id(url: str) -> Column:
    parts = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"[?&]v=([A-Za-z0-9_-]{11})", r"youtu\.be/([A-Za-z0-9_-]{11})", r"/shorts/([A-Za-z0-9_-]{11})")]
    return F.coalesce(*parts)


def summary_preview(markdown: str) -> Column:
    """First line without references, number and markup, at most 160 characters."""
    text = F.col(markdown)
    for pattern in (r"\[#\d+\]\([^)]*\)", r"\[#\d+\]", r"\A\s*\d+\.\s*", r"[*_`]", r"\A\s+|\s+\z"):
        text = F.regexp_replace(text, pattern, "")
    line = F.substring_index(text, "\n", 1)
    return F.when(F.length(line) > 160, F.concat(F.trim(F.left(line, F.lit(160))), F.lit("…"))).otherwise(line)


def linkify(markdown: str, base: str) -> Column:
    """[#123] as a link to the item."""
    return F.regexp_replace(markdown, r"\[#(\d+)\](?!\()", rf"[#$1]({base}$1)")


def xml_escape(text: str) -> Column:
    out = F.col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cdata(text: str) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(F.col(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def phrases(rows: DataFrame, text: str, banned: tuple[str, ...], around: int = 15) -> DataFrame:
    """All columns and hits: the first place of each banned phrase that occurs, with what stands around it."""
    col = F.col(text)
    hits = [
        F.when(F.instr(col, p) > 0, F.struct(F.lit(p).alias("phrase"), (F.instr(col, p) - 1).alias("at"), F.substring(col, F.greatest(F.lit(1), F.instr(col, p) - around), F.lit(len(p) + around) + F.least(F.instr(col, p) - 1, F.lit(around))).alias("snippet")))
        for p in banned
    ]
    return rows.withColumn("hits", F.filter(F.array(*hits), lambda h: h.isNotNull())).withColumn("passed", F.size("hits") == 0)


def model_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call by a price table (model, rate_in, rate_out, rate_cached or null), per million tokens; null where there is no price.

    The price table is a few rows; Spark broadcasts it by its own size check."""
    p = prices.select(F.col("model").alias("p_model"), "rate_in", "rate_out", "rate_cached")
    fresh = (F.col("input_tokens") - F.col("cached_input_tokens")) * F.col("rate_in")
    cost = fresh + F.col("cached_input_tokens") * F.coalesce("rate_cached", "rate_in") + (F.col("output_tokens") + F.col("reasoning_tokens")) * F.col("rate_out")
    exact = F.round(cost.cast("decimal(24,4)") * F.lit(Decimal("0.000001")), 6)
    return usage.join(p, F.col("model") == F.col("p_model"), "left").withColumn("computed_usd", exact).drop("p_model", "rate_in", "rate_out", "rate_cached")
