"""What a search looks through, and which kind of search it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feed import FeedQuery, feed, flat_tags
from .vectors import Index, search_all


def searchable(items: DataFrame, sources: DataFrame, clusters: DataFrame, source_id: str | None = None, source_group: str | None = None, source_kind: str | None = None, date_from: str | None = None, date_to: str | None = None, include_excluded: bool = False) -> DataFrame:
    """Embedded, enriched items, of an event its lead only, within the filters; excluded ones only on request, and an item without a tier
    counts as excluded. Filters and columns reach the scans; only ids and vectors go on."""
    rows = items.where("embedding IS NOT NULL AND enriched_at IS NOT NULL")
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    if date_from or date_to:
        rows = rows.where((F.col("published_at") >= F.lit(date_from or "1970-01-01").cast("timestamp_ntz")) & (F.col("published_at") < F.lit(date_to or "2999-01-01").cast("timestamp_ntz")))
    if source_group or source_kind:
        own = sources.where((F.col("grp") == source_group) if source_group else F.lit(True)).where((F.col("kind") == source_kind) if source_kind else F.lit(True))
    else:
        own = sources
    rows = rows.join(F.broadcast(own.select(F.col("id").alias("s_id"))), F.col("source_id") == F.col("s_id"), "left_semi")  # a row a source
    event = clusters.select(F.col("id").alias("c_id"), "lead_item_id", "event_tier")
    rows = rows.join(event, F.col("cluster_id") == F.col("c_id"), "left").where("cluster_id IS NULL OR lead_item_id = id")
    if not include_excluded:
        rows = rows.where(F.coalesce("event_tier", "tier") != "excluded")
    return rows.select("id", "embedding")


def by_vectors(words: str, queries: DataFrame, found: DataFrame, limit: int = 20) -> DataFrame:
    """The nearest of `found` for each query vector, 1 to 100 of them; none for blank words."""
    return search_all(found.limit(0) if not words.strip() else found, queries, max(1, min(100, limit)))


def results(near: DataFrame, items: DataFrame, sources: DataFrame, locale: str = "en") -> DataFrame:
    """What was found (q_id, id, distance, rank) as a reader sees it: each item's own title, tier and importance, never its event's.

    Only found rows meet the items: the ranking was done on ids and vectors alone."""
    a, b = ("en", "zh") if locale == "en" else ("zh", "en")
    rows = near.join(items, "id").join(F.broadcast(sources.select(F.col("id").alias("s_id"), F.col(f"name_{a}").alias("publisher"), F.col("grp").alias("source_group"), F.col("kind").alias("source_kind"))), F.col("source_id") == F.col("s_id"))  # a row a source
    return rows.select(
        "q_id", "rank", "id", "distance", F.coalesce(f"title_{a}", f"title_{b}", "title").alias("title"), F.coalesce(f"summary_{a}", f"summary_{b}", F.lit("")).alias("summary"), "publisher", "source_id", "source_group", "source_kind",
        F.coalesce("tier", F.lit("all")).alias("tier"), F.coalesce("importance", F.lit(0)).alias("importance"), F.struct("hkr_h", "hkr_k", "hkr_r").alias("hkr"), flat_tags("capabilities", "entities", "topics", 4).alias("tags"),
        "url", "published_at", F.coalesce(f"editor_note_{a}", f"editor_note_{b}").isNotNull().alias("commented"), "cluster_id",
    )


def search(mode: str, q: FeedQuery, items: DataFrame, sources: DataFrame, clusters: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """A search of mode "lexical", the feed that q asks for, or "semantic": results() for each of `queries` (q_id, vector) among what q's
    source and dates leave, excluded items only with tier "all"; from an `index` of those rows if there is one."""
    if mode == "lexical":
        return feed(items, sources, clusters, q)
    if mode != "semantic":
        raise ValueError(f"no mode of search: {mode}")
    if index is not None and (q.search or "").strip():
        near = index.search(queries, max(1, min(100, q.limit)))
    else:
        found = searchable(items, sources, clusters, q.source_id, q.source_group, q.source_kind, q.date_from, q.date_to, q.tier == "all")
        near = by_vectors(q.search or "", queries, found, q.limit)
    return results(near, items, sources, q.locale)
