"""Daily pool, newsletter, ticker, RSS lanes and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import overlaps

PAPERS = ("arxiv", "paper")


def _ts(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def day_window(now: str) -> tuple[Column, Column]:
    """The last 24 hours up to the full hour."""
    end = F.date_trunc("hour", _ts(now)).cast("timestamp_ntz")
    return end - F.expr("INTERVAL 24 HOURS"), end


def month_window(now: str) -> tuple[Column, Column]:
    end = F.date_trunc("day", _ts(now)).cast("timestamp_ntz")
    return end - F.expr("INTERVAL 30 DAYS"), end


def daily_pool(items: DataFrame, sources: DataFrame, now: str, hot: int = 25, most: int = 20, least: int = 5) -> DataFrame:
    """Curated items of the window, then the hottest ones; one of each event; `most` in all; none if fewer than `least`."""
    start, end = day_window(now)
    rows = items.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "tags", "curated")), "source_id")
    rows = rows.where((F.col("published_at") >= start) & (F.col("published_at") < end) & ~overlaps("tags", PAPERS) & F.col("enriched_at").isNotNull())
    order = [F.desc_nulls_last("importance"), F.desc("published_at"), F.asc("id")]
    top = rows.orderBy(*order).limit(hot)  # at most `hot` rows
    both = rows.where("curated").withColumn("pool", F.lit(0)).unionByName(top.withColumn("pool", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("pool"))
    both = both.withColumn("k", first).where("k = 1")
    one = F.row_number().over(Window.partitionBy(F.coalesce(F.col("cluster_id"), -1 - F.col("id"))).orderBy("pool", *order))
    pool = both.withColumn("k", one).where("k = 1").orderBy("pool", *order).limit(most)
    n = F.count("*").over(Window.partitionBy())  # `most` rows
    return pool.withColumn("n", n).where(F.col("n") >= least).select("id", "cluster_id", "importance", (F.col("pool") == 0).alias("from_curated"))


def written_pool(items: DataFrame, sources: DataFrame, now: str, folder: str, **sizes: int) -> DataFrame:
    """All pools written in `folder` so far (window, and daily_pool()'s columns), after that of `now`'s window is.

    The key is the window's end, the full hour: a run again within the hour replaces that window's rows alone, also when the pool is empty by then."""
    pool = daily_pool(items, sources, now, **sizes)
    end = items.sparkSession.range(1).select(F.date_format(day_window(now)[1], "yyyy-MM-dd-HH").alias("end")).head()["end"]
    pool.coalesce(1).write.mode("overwrite").parquet(f"{folder}/window={end}")  # `most` rows at most
    return items.sparkSession.read.schema(pool.schema.add("window", "string")).parquet(folder)


def newsletter(items: DataFrame, now: str, top: int = 75, least: int = 3) -> DataFrame:
    """The top items of the month's window; none if fewer than `least`."""
    start, end = month_window(now)
    rows = items.where(F.col("enriched_at").isNotNull() & F.col("importance").isNotNull() & (F.col("published_at") >= start) & (F.col("published_at") < end))
    best = rows.orderBy(F.desc_nulls_last("importance"), F.desc("published_at"), F.asc("id")).limit(top)
    return best.withColumn("n", F.count("*").over(Window.partitionBy())).where(F.col("n") >= least).select("id", "importance")  # `top` rows


def ticker(items: DataFrame, sources: DataFrame, now: str, locale: str = "en", limit: int = 12) -> DataFrame:
    a, b = ("en", "zh") if locale == "en" else ("zh", "en")
    since = _ts(now) - F.expr("INTERVAL 24 HOURS")
    rows = items.where((F.col("created_at") >= since) & F.col("importance").isNotNull() & F.col("tier").isin("featured", "p1"))
    rows = rows.join(F.broadcast(sources.select(F.col("id").alias("source_id"), f"name_{a}")), "source_id").orderBy(F.desc("importance"), F.desc("id")).limit(limit)
    title = F.coalesce(f"title_{a}", f"title_{b}", "title")
    cut = F.when(F.length(title) <= 44, title).otherwise(F.concat(F.rtrim(F.left(title, F.lit(43))), F.lit("…")))
    kind = F.when(F.col("tier") == "p1", "hot").when(F.col("importance") >= 90, "up")
    return rows.select("id", F.left(F.upper(f"name_{a}"), F.lit(20)).alias("lab"), cut.alias("val"), kind.alias("kind"), F.col("importance").cast("string").alias("extra"))


def rss_lane(items: DataFrame, sources: DataFrame, lane: str, now: str, limit: int = 50) -> DataFrame:
    """The newest items of a lane: today (no papers), curated, papers. Neither tier nor enrichment filters here."""
    rows = items.join(F.broadcast(sources.select(F.col("id").alias("source_id"), "tags", "curated")), "source_id")
    if lane == "today":
        rows = rows.where(~overlaps("tags", PAPERS) & (F.col("published_at") >= F.date_trunc("day", _ts(now) - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")))
    elif lane == "curated":
        rows = rows.where("curated")
    elif lane == "papers":
        rows = rows.where(overlaps("tags", PAPERS))
    else:
        raise ValueError(f"lane: {lane}")
    return rows.orderBy(F.desc("published_at"), F.desc("id")).limit(limit).select("id", "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first frame, or the second where the first has no rows; in one plan, for small results."""
    both = first.withColumn("level", F.lit(0)).unionByName(second.withColumn("level", F.lit(1)))
    return both.withColumn("least", F.min("level").over(Window.partitionBy())).where("level = least").drop("level", "least")


def enrich_queue(items: DataFrame, limit: int = 200) -> DataFrame:
    """Items to enrich next: those with a long body first, then the latest."""
    rank = F.when(F.length("body_md") >= 400, 0).when(F.length("body") >= 400, 1).otherwise(2)
    return items.where("enriched_at IS NULL").withColumn("rank", rank).orderBy("rank", F.desc("published_at"), "id").limit(limit).select("id", "rank")


def body_queue(items: DataFrame, limit: int = 100) -> DataFrame:
    """Items whose article text is to be fetched: by tier, then the latest; hosts without articles left out."""
    rank = F.expr("CASE tier WHEN 'p1' THEN 0 WHEN 'featured' THEN 1 WHEN 'all' THEN 2 ELSE 3 END")
    hosts = ~F.col("url").like("%youtube.com/%") & ~F.col("url").like("%//x.com/%")
    return items.where(F.col("body_md").isNull() & hosts).withColumn("rank", rank).orderBy("rank", F.desc("published_at"), "id").limit(limit).select("id", "tier", "rank")


def transcript_queue(items: DataFrame, limit: int = 50) -> DataFrame:
    """Videos whose transcript is to be fetched: by tier, featured first, then the latest."""
    rank = F.expr("CASE tier WHEN 'featured' THEN 0 WHEN 'p1' THEN 1 WHEN 'all' THEN 2 WHEN 'excluded' THEN 3 ELSE 4 END")
    video = F.col("url").like("%youtube.com/watch%") | F.col("url").like("%youtu.be/%") | F.col("url").like("%youtube.com/shorts/%")
    return items.where(F.col("body_md").isNull() & video).withColumn("rank", rank).orderBy("rank", F.desc("published_at"), "id").limit(limit).select("id", "tier", "rank")


def active_sources(sources: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Enabled sources in the order of the groups as declared, not of the alphabet, then by name."""
    rank = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp"))
    return sources.where("enabled").withColumn("rank", rank.cast("int")).orderBy("rank", "name_en").select("id", "grp", "name_en", "rank")
