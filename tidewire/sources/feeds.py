"""Parsing what was fetched: RSS 2.0, Atom 1.0, posts in JSON; and what to fetch next.

XML and JSON go through Spark's own from_xml and from_json with fixed schemas: no schema inference, no Python. A feed of one
entry and one of many look alike, and text with attributes or in CDATA is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import first_line_title

_TEXT = "struct<_VALUE:string>"
_RSS = f"channel struct<item:array<struct<title:{_TEXT},link:{_TEXT},guid:{_TEXT},pubDate:{_TEXT},`dc:date`:{_TEXT},description:{_TEXT},`content:encoded`:{_TEXT}>>>"
_ATOM = f"entry array<struct<id:{_TEXT},title:{_TEXT},link:array<struct<_rel:string,_href:string,_VALUE:string>>,published:{_TEXT},updated:{_TEXT},summary:{_TEXT},content:{_TEXT}>>"
FIELDS = ("external_id", "url", "title", "published_at", "body")


def parse_date(text: Column) -> Column:
    """RFC 822 and ISO dates as timestamps; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    offset = F.regexp_replace(plain, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    forms = [F.try_to_timestamp(offset, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    return F.coalesce(*forms, F.when(plain.rlike(r"^\d{4}-\d\d-\d\d"), plain.try_cast("timestamp")))


def _text(value: Column) -> Column:
    return F.nullif(F.regexp_replace(value["_VALUE"], r"^\s+|\s+$", ""), F.lit(""))


def _entries(kind: str) -> tuple[Column, ...]:
    e = F.col("_e")
    if kind == "rss":
        link, guid = _text(e["link"]), _text(e["guid"])
        body = F.coalesce(_text(e["content:encoded"]), _text(e["description"]))
        return F.coalesce(guid, link), F.coalesce(link, guid), _text(e["title"]), F.coalesce(parse_date(_text(e["pubDate"])), parse_date(_text(e["dc:date"]))), body
    # the first link that names no relation, or says that it is the page itself
    main = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("")).isin("", "alternate"))
    first = F.try_element_at(main, F.lit(1))
    link, own = F.nullif(F.coalesce(first["_href"], F.trim(first["_VALUE"])), F.lit("")), _text(e["id"])
    return F.coalesce(own, link), F.coalesce(link, own), _text(e["title"]), F.coalesce(parse_date(_text(e["published"])), parse_date(_text(e["updated"]))), F.coalesce(_text(e["content"]), _text(e["summary"]))


def parse_feed(rows: DataFrame, payload: str = "payload", strict: bool = True) -> DataFrame:
    """One row for each entry of an RSS 2.0 or Atom 1.0 document, with the other columns of `rows`.

    An entry without link and id is left out; one without a title is "(untitled)"; a date that is no date is null. A feed without
    entries gives no rows. A document that is neither is an error, or without `strict` gives no rows."""
    keep = [c for c in rows.columns if c != payload]
    root = F.regexp_extract(F.regexp_replace(payload, r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>", ""), r"^\s*<([A-Za-z:]+)", 1)
    named = rows.withColumn("_root", root)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("neither RSS 2.0 nor Atom 1.0: <"), F.coalesce("_root", F.lit("")), F.lit(">")))
        named = named.where(F.when(F.col("_root").isin("rss", "feed"), True).otherwise(wrong.cast("boolean")))
    out = []
    for kind, tag, schema in (("rss", "rss", _RSS), ("atom", "feed", _ATOM)):
        doc = F.from_xml(payload, schema)
        part = named.where(F.col("_root") == tag).withColumn("_e", F.explode(doc["channel"]["item"] if kind == "rss" else doc["entry"]))
        ident, url, title, at, body = _entries(kind)
        part = part.select(*keep, ident.alias("external_id"), url.alias("url"), F.coalesce(title, F.lit("(untitled)")).alias("title"), at.alias("published_at"), body.alias("body"))
        out.append(part.where("external_id IS NOT NULL"))
    return out[0].unionByName(out[1])


_TWEET = "struct<id:string,text:string,created_at:string,note_tweet:struct<text:string>,referenced_tweets:array<struct<type:string>>>"


def parse_tweets(rows: DataFrame, handle: str, payload: str = "payload", now: str | None = None) -> DataFrame:
    """One row for each post of a JSON document each, but for reposts, replies and empty ones; the long text where there is one."""
    t = F.col("_t")
    parsed = rows.withColumn("_t", F.from_json(payload, _TWEET))
    refs = F.exists(t["referenced_tweets"], lambda r: r["type"].isin("retweeted", "replied_to"))
    trim = lambda c: F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))
    full = F.coalesce(trim(t["note_tweet"]["text"]), trim(t["text"]))
    kept = parsed.where(~F.coalesce(refs, F.lit(False))).withColumn("body", full).where("body IS NOT NULL")
    url = F.concat(F.lit("https://x.com/"), F.col(handle), F.lit("/status/"), t["id"])
    keep = [c for c in rows.columns if c != payload]
    at = F.coalesce(parse_date(t["created_at"]), F.lit(now).cast("timestamp") if now else F.current_timestamp())
    return kept.select(*keep, t["id"].alias("external_id"), url.alias("url"), first_line_title("body").alias("title"), at.alias("published_at"), "body")


#: Which kinds of source a fetcher exists for.
FETCHED_KINDS = ("rss", "atom", "rsshub", "x-api")


def due_sources(sources: DataFrame, *cadences: str) -> DataFrame:
    """Enabled sources of the given cadences, with `pending` for kinds that nothing fetches."""
    return sources.where(F.col("enabled") & F.col("cadence").isin(*cadences)).withColumn("pending", ~F.col("kind").isin(*FETCHED_KINDS))


def after_cursor(posts: DataFrame, cursors: DataFrame, most: int | None = None) -> DataFrame:
    """Posts (source_id, external_id as a growing number) beyond each source's cursor (source_id, last_external_id; none: all).

    With `most`, the latest so many of each source."""
    c = cursors.select(F.col("source_id").alias("_s"), F.col("last_external_id").cast("decimal(38,0)").alias("_last"))
    number = F.col("external_id").cast("decimal(38,0)")
    rows = posts.join(c, F.col("source_id") == F.col("_s"), "left").where(F.col("_last").isNull() | (number > F.col("_last"))).drop("_s", "_last")
    return rows if most is None else capped(rows, most)


def capped(posts: DataFrame, most: int) -> DataFrame:
    """The `most` latest posts of each source; a source's rows are cut before they are shuffled."""
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy(F.col("external_id").cast("decimal(38,0)").desc())
    return posts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def advanced(cursors: DataFrame, seen: DataFrame) -> DataFrame:
    """The cursors after posts were seen: they only grow, and a source that showed nothing new keeps its own."""
    new = seen.groupBy("source_id").agg(F.max(F.col("external_id").cast("decimal(38,0)")).alias("_new"))
    both = cursors.join(new, "source_id", "full")
    return both.select("source_id", F.greatest(F.col("last_external_id").cast("decimal(38,0)"), "_new").cast("string").alias("last_external_id"))


def category(url: str) -> Column:
    """The subject class that the address of a preprint feed or search names, such as cs.CL; null without one."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"rss\.arxiv\.org/rss/([\w.]+)", r"search_query=cat:([\w.]+)")]
    return F.coalesce(*found)


def in_window(at: str, since: str, until: str) -> Column:
    """Within [since, until]; what has no date stays."""
    return F.col(at).isNull() | F.col(at).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp"))


def compact_timestamp(text: str) -> Column:
    """A date of 14 digits; null where it is anything else."""
    return F.when(F.col(text).rlike(r"^\d{14}$"), F.try_to_timestamp(F.col(text), F.lit("yyyyMMddHHmmss")))
