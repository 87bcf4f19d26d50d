"""Archive indexes and feeds: reading JSON indexes, writing RSS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import xml_escape


def parse_index(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each capture of a JSON index, an array of arrays whose first row names the columns.

    Payloads that are empty, no JSON or only a header have no captures; absent columns are null.
    """
    grid = F.from_json(payload, "array<array<string>>")
    held = rows.withColumn("_grid", grid).filter(F.size("_grid") > 1).withColumn("_head", F.col("_grid")[0])
    lines = held.withColumn("_line", F.explode(F.slice("_grid", 2, F.size("_grid") - 1)))
    field = lambda name: F.when(F.array_position("_head", name) > 0, F.try_element_at("_line", F.array_position("_head", name).cast("int"))).alias(name)
    keep = [c for c in rows.columns if c != payload]
    return lines.select(*keep, *[field(n) for n in ("timestamp", "original", "mimetype", "statuscode", "digest")])


def rfc822(ts: str) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def rss_item(title: str, link: str, description: str, ts: str, guid: str) -> Column:
    """An RSS 2.0 item; nulls are empty elements."""
    part = lambda tag, value: F.concat(F.lit(f"<{tag}>"), F.coalesce(value, F.lit("")), F.lit(f"</{tag.split()[0]}>"))
    return F.concat(
        F.lit("<item>"), part("title", xml_escape(title)), part("link", xml_escape(link)), part("description", xml_escape(description)),
        part("pubDate", rfc822(ts)), part('guid isPermaLink="false"', xml_escape(guid)), F.lit("</item>"),
    )
