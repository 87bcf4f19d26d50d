"""The feed: a validated query object, its predicates, ranking and projection to stories."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$")


@dataclass(frozen=True)
class FeedQuery:
    """What a feed asks for; absent parts don't filter. Wildcards % and _ in `search` count as such."""

    now: str
    tier: str = "featured"
    view: str = "archive"
    locale: str = "en"
    source_id: str | None = None
    source_group: str | None = None
    source_kind: str | None = None
    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    hot_hours: int = 24
    search: str | None = None
    curated_only: bool = False
    exclude_tags: tuple[str, ...] = ()
    include_tags: tuple[str, ...] = ()
    min_importance: int | None = None
    rescue_days: int | None = None
    max_per_day: int | None = None
    limit: int = 40
    offset: int = 0

    def __post_init__(self) -> None:
        if self.tier not in ("featured", "p1", "all"):
            raise ValueError(f"tier: {self.tier}")
        if self.view not in ("today", "archive"):
            raise ValueError(f"view: {self.view}")
        if self.locale not in ("en", "zh"):
            raise ValueError(f"locale: {self.locale}")
        if not 1 <= self.limit <= 500 or self.offset < 0:
            raise ValueError("limit is 1 to 500, offset 0 or more")
        if not 1 <= self.hot_hours <= 168:
            raise ValueError("hot_hours is 1 to 168")
        if self.date is not None and not DAY.match(self.date):
            raise ValueError(f"date: {self.date}")


def tag_list(text: str | None) -> tuple[str, ...]:
    """Tags of a comma-separated parameter: trimmed, empty ones dropped."""
    return tuple(t for t in (p.strip() for p in (text or "").split(",")) if t)


#: Source presets: name to the parts of a query that they set.
PRESETS = {
    "official": {"source_group": "vendor-official"}, "newsletter": {"source_group": "newsletter"}, "media": {"source_group": "media"},
    "research": {"source_group": "research"}, "x": {"source_kind": "x-api"},
}


def preset(query: FeedQuery, name: str | None) -> FeedQuery:
    return replace(query, **PRESETS.get(name or "", {}))


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def joined(items: DataFrame, sources: DataFrame, clusters: DataFrame) -> DataFrame:
    """Items with their source and, where they have one, their event. Sources are a few rows; the other side decides by size."""
    src = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    ev = clusters.select(*[F.col(c).alias(f"c_{c}") for c in clusters.columns])
    return items.join(F.broadcast(src), F.col("source_id") == F.col("s_id")).join(ev, F.col("cluster_id") == F.col("c_id"), "left")


def overlaps(array: str, tags: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(array), F.array(*[F.lit(t) for t in tags])), F.lit(False))


def where(q: FeedQuery) -> Column:
    """The conjunction of a query's predicates over joined(): shared by the feed and its count."""
    tier = F.coalesce("c_event_tier", "tier")
    importance = F.coalesce("c_importance", "importance")
    day = F.date_trunc("day", _ts(q.now)).cast("timestamp_ntz")
    test = F.col("enriched_at").isNotNull() & F.col("importance").isNotNull()
    test &= {"p1": tier == "p1", "featured": tier.isin("featured", "p1"), "all": tier != "excluded"}[q.tier]
    test &= F.col("cluster_id").isNull() | (F.col("c_lead_item_id") == F.col("id"))
    for column, value in (("source_id", q.source_id), ("s_grp", q.source_group), ("s_kind", q.source_kind)):
        if value:
            test &= F.col(column) == value
    pub = F.col("published_at")
    if q.date:
        test &= (pub >= _ts(q.date)) & (pub < _ts(q.date) + F.expr("INTERVAL 1 DAY"))
    elif q.date_from or q.date_to:
        test &= (pub >= _ts(q.date_from or "1970-01-01")) & (pub < _ts(q.date_to or "2999-01-01"))
    elif q.view == "today":
        hot = _ts(q.now) - F.make_interval(hours=F.lit(q.hot_hours))
        test &= F.coalesce(F.col("c_first_seen_at") >= day, F.lit(False)) | F.coalesce(F.col("c_latest_member_at") > hot, F.lit(False)) | (pub >= day - F.expr("INTERVAL 1 DAY"))
    if q.search:
        fields = ("title", "title_zh", "title_en", "summary_zh", "summary_en", "c_canonical_title_zh", "c_canonical_title_en")
        any_of = F.lit(False)
        for f in fields:
            any_of |= F.coalesce(F.col(f).ilike(f"%{q.search}%"), F.lit(False))
        test &= any_of
    if q.curated_only:
        test &= F.col("s_curated")
    if q.exclude_tags:
        test &= ~overlaps("s_tags", q.exclude_tags)
    if q.include_tags:
        test &= overlaps("s_tags", q.include_tags)
    if q.min_importance:
        enough = importance >= q.min_importance
        if q.rescue_days:
            enough |= pub >= day - F.make_interval(days=F.lit(q.rescue_days - 1))
        test &= enough
    return test


def ranked(rows: DataFrame, q: FeedQuery) -> DataFrame:
    """Filtered rows in feed order, cut to the page; id settles ties. With max_per_day: each day's strongest first, out of a wider page."""
    importance = F.coalesce("c_importance", "importance")
    hits = rows.where(where(q)).withColumn("eff", importance).withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    if not q.max_per_day:
        return hits.orderBy(F.desc("published_at"), F.desc("eff"), F.desc("id")).offset(q.offset).limit(q.limit)
    by = [F.desc("day"), F.desc("eff"), F.desc("published_at"), F.desc("id")]
    wide = min(max(q.limit * 5, 200), 500)
    from pyspark.sql import Window

    page = hits.orderBy(*by).offset(q.offset).limit(wide)  # at most 500 rows
    place = F.row_number().over(Window.partitionBy("day").orderBy(*by[1:]))
    return page.withColumn("place", place).where(F.col("place") <= q.max_per_day).orderBy(*by).limit(q.limit)


def flat_tags(first: str, second: str, third: str, most: int) -> Column:
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in (first, second, third)]
    return F.slice(F.concat(*parts), 1, most)


def stories(rows: DataFrame, q: FeedQuery) -> DataFrame:
    """What a reader sees of each row."""
    a, b = ("en", "zh") if q.locale == "en" else ("zh", "en")
    multi = F.col("c_member_count") > 1
    today = F.date_trunc("day", _ts(q.now)).cast("timestamp_ntz")
    hot = _ts(q.now) - F.make_interval(hours=F.lit(q.hot_hours))
    tier = F.coalesce("c_event_tier", "tier", F.lit("all"))
    return rows.select(
        "id", "source_id", F.col(f"s_name_{a}").alias("publisher"), F.col("s_kind").alias("kind"), F.col("s_grp").alias("grp"), tier.isin("featured", "p1").alias("featured"),
        F.coalesce(f"c_canonical_title_{a}", f"title_{a}", f"title_{b}", "title").alias("title"),
        F.coalesce(f"summary_{a}", f"summary_{b}", F.lit("")).alias("summary"),
        F.array_join(flat_tags("capabilities", "entities", "topics", 4), ",").alias("tags"),
        F.coalesce("c_importance", "importance", F.lit(0)).alias("importance"), tier.alias("tier"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "url",
        F.coalesce(f"c_editor_note_{a}", f"c_editor_note_{b}", f"editor_note_{a}", f"editor_note_{b}").alias("editor_note"),
        *[F.coalesce(f"c_hkr_{x}", f"hkr_{x}").alias(f"hkr_{x}") for x in "hkr"],
        "cluster_id", F.when(multi, F.col("c_member_count")).alias("coverage"), F.when(multi, F.col("c_member_count") - 1).alias("cross_source_count"),
        ((F.col("c_first_seen_at") < today) & (F.col("c_latest_member_at") > hot)).alias("still_developing"),
    )


def feed(items: DataFrame, sources: DataFrame, clusters: DataFrame, q: FeedQuery) -> DataFrame:
    return stories(ranked(joined(items, sources, clusters), q), q)


def feed_count(items: DataFrame, sources: DataFrame, clusters: DataFrame, q: FeedQuery) -> DataFrame:
    """Rows that the query matches, over all pages; the cap by day doesn't count."""
    return joined(items, sources, clusters).where(where(q)).agg(F.count("*").alias("total"))


def event_badge(rows: DataFrame, now: str) -> DataFrame:
    """Badge of each event: broke today, or developing for so many whole days, one at least; none for single items."""
    today = F.date_trunc("day", _ts(now)).cast("timestamp_ntz")
    days = F.greatest(F.lit(1), F.floor((F.unix_micros(_ts(now).cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / F.lit(86_400_000_000)).cast("int"))
    fresh = F.col("first_seen_at") >= today
    return rows.select(F.col("id").alias("cluster_id"), F.when(F.col("member_count") <= 1, None).when(fresh, F.concat(F.lit("NEW·"), F.col("member_count"))).otherwise(F.concat(F.lit("dev·"), days, F.lit("d"))).alias("badge"))
