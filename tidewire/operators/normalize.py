"""From fetched rows to items: body, title, canonical address, content hash, and which rows make a new item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.content import payload_body, strip_markup, trimmed
from tidewire.functions.text import canonical_url, content_hash


def normalize(raw: DataFrame, now: str, known: DataFrame | None = None) -> DataFrame:
    """Each row of `raw` (id, source_id, url, title, published_at, payload as JSON) with what an item needs, and its outcome.

    outcome: skipped without an address; deduped where an item in `known` (content_hash), or a row of a lesser id, has the same
    content hash; else created. The hash covers canonical address, title and body. Dates default to `now`.
    Equal hashes are counted map-side; no group is gathered."""
    url = trimmed(F.coalesce("url", F.lit("")))
    title = trimmed(F.coalesce("title", F.lit("")))
    rows = raw.select(
        "id", "source_id", url.alias("url"), F.when(title == "", "(untitled)").otherwise(title).alias("title"),
        strip_markup(payload_body("payload")).alias("body"), F.coalesce("published_at", F.lit(now).cast("timestamp_ntz")).alias("published_at"),
    ).withColumn("canonical_url", F.when(F.col("url") != "", canonical_url("url")))
    rows = rows.withColumn("content_hash", F.when(F.col("url") != "", content_hash(F.concat("canonical_url", F.lit("\n\n"), "title"), F.col("body"))))
    # rows without a hash are known by their address, and the key can't be null: tests of the hash would be pushed down and compute it once more
    first = rows.where("url <> ''").groupBy(F.coalesce("content_hash", F.lit("")).alias("h")).agg(F.min("id").alias("first_id"))
    if known is not None:
        old = known.select(F.col("content_hash").alias("h")).distinct().withColumn("old", F.lit(True))
        first = first.join(old, "h", "left")
    else:
        first = first.withColumn("old", F.lit(None).cast("boolean"))
    both = rows.join(first, F.col("content_hash") == F.col("h"), "left")
    fresh = (F.col("id") == F.col("first_id")) & F.col("old").isNull()
    outcome = F.when(F.col("url") == "", "skipped").when(fresh, "created").otherwise("deduped")
    return both.withColumn("outcome", outcome).drop("h", "first_id", "old")


def outcomes(normalized: DataFrame) -> DataFrame:
    """How many rows had each outcome."""
    return normalized.groupBy("outcome").agg(F.count("*").alias("n"))
