"""Single items as a reader, and as the programming interface, sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import FeedQuery, flat_tags, joined, stories


def details(items: DataFrame, sources: DataFrame, locale: str = "en") -> DataFrame:
    """Every enriched item that isn't excluded, by itself: its own titles, tier and importance, never its event's."""
    a, b = ("en", "zh") if locale == "en" else ("zh", "en")
    src = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    rows = items.where("enriched_at IS NOT NULL AND (tier IS NULL OR tier <> 'excluded')").join(F.broadcast(src), F.col("source_id") == F.col("s_id"))  # a row a source
    return rows.select(
        "id", "source_id", F.col(f"s_name_{a}").alias("publisher"), F.col("s_kind").alias("kind"), F.col("s_grp").alias("grp"), F.coalesce("s_locale", F.lit("multi")).alias("locale"),
        F.coalesce(F.col("tier").isin("featured", "p1"), F.lit(False)).alias("featured"), F.coalesce(f"title_{a}", f"title_{b}", "title").alias("title"),
        F.coalesce(f"summary_{a}", f"summary_{b}", F.lit("")).alias("summary"), F.array_join(flat_tags("capabilities", "entities", "topics", 6), ",").alias("tags"),
        F.coalesce("importance", F.lit(0)).alias("importance"), F.coalesce("tier", F.lit("all")).alias("tier"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "url",
        F.coalesce(f"editor_note_{a}", f"editor_note_{b}").alias("editor_note"), "body_md",
    )


def detail(items: DataFrame, sources: DataFrame, item_id: int, locale: str = "en") -> DataFrame:
    """One item, or none: where the id is no positive whole number, or the item isn't enriched, or excluded."""
    if isinstance(item_id, bool) or not isinstance(item_id, int) or item_id <= 0:
        return details(items, sources, locale).limit(0)
    return details(items.where(F.col("id") == item_id), sources, locale)


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def pages(items: DataFrame, sources: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items with nested parts, enriched or not; `event` only for events of two or more members."""
    rows = joined(items, sources, clusters)
    pair = lambda front: F.struct(F.col(f"{front}_zh").alias("zh"), F.col(f"{front}_en").alias("en"))
    event = F.struct(
        "cluster_id", F.col("c_member_count").alias("coverage"), F.col("c_event_tier").alias("tier"), F.col("c_importance").alias("importance"),
        _stamp("c_verified_at").alias("verified_at"), _stamp("c_first_seen_at").alias("first_seen_at"), _stamp("c_latest_member_at").alias("latest_member_at"),
        pair("c_canonical_title").alias("canonical_title"), pair("c_editor_note").alias("editor_note"), _stamp("c_commentary_at").alias("commentary_at"),
        F.concat(F.lit("/api/v1/events/"), F.col("cluster_id").cast("string"), F.lit("/members")).alias("members_url"),
    )
    tags = F.struct(*[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("capabilities", "entities", "topics")])
    return rows.select(
        "id", F.struct(F.col("s_id").alias("id"), F.col("s_name_en").alias("name_en"), F.col("s_name_zh").alias("name_zh"), F.col("s_kind").alias("kind"), F.col("s_grp").alias("group"), F.col("s_locale").alias("locale")).alias("source"),
        F.struct(F.col("title").alias("raw"), F.col("title_zh").alias("zh"), F.col("title_en").alias("en")).alias("title"), pair("summary").alias("summary"), pair("editor_note").alias("editor_note"),
        F.struct("hkr_h", "hkr_k", "hkr_r").alias("hkr"), tags.alias("tags"), "importance", "tier", "url", _stamp("published_at").alias("published_at"), _stamp("enriched_at").alias("enriched_at"),
        "body_md", F.col("body").alias("body_rss"), F.when(F.col("cluster_id").isNotNull() & (F.coalesce("c_member_count", F.lit(0)) > 1), event).alias("event"),
    )


def interface_items(rows: DataFrame, q: FeedQuery) -> DataFrame:
    """Rows of joined(), filtered and ordered, as the interface gives them: event titles and dates only for events of two or more."""
    a = "zh" if q.locale == "zh" else "en"
    own = stories(rows, q)
    extra = rows.select(F.col("id").alias("_id"), F.col(f"c_canonical_title_{a}").alias("_canonical"), F.col("c_first_seen_at").alias("_first"), F.col("c_latest_member_at").alias("_last"), F.col("cluster_id").alias("_cluster"))
    both = own.join(extra, own["id"] == F.col("_id"))  # a page of rows on either side
    multi = (F.coalesce("coverage", F.lit(0)) > 1) & F.col("_cluster").isNotNull()
    return both.select(
        "id", "title", "summary", "publisher", "source_id", F.col("grp").alias("source_group"), F.col("kind").alias("source_kind"), "tier", "importance", "tags", "url", "published_at",
        (F.coalesce("editor_note", F.lit("")) != "").alias("has_commentary"), F.coalesce("cross_source_count", "coverage").alias("cross_source_count"), "cluster_id", "coverage",
        F.when(multi, F.col("_canonical")).alias("canonical_title"), _stamp("_first").alias("first_seen_at"), _stamp("_last").alias("latest_member_at"), F.when(F.col("still_developing"), True).alias("still_developing"),
    )


def pick_sources(sources: DataFrame, query: str, most: int = 60) -> DataFrame:
    """Sources whose id or a name contains the words, in any case; all for none; the first `most` by id."""
    q = query.strip().lower()
    hit = F.lit(True)
    if q:
        hit = F.lower("name_en").contains(q) | F.lower("name_zh").contains(q) | F.lower("id").contains(q)
    return sources.where(hit).orderBy("id").limit(most)
