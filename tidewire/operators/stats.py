"""Counts and roll-ups over items, sources, the model-call ledger and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .feed import joined, overlaps


def _ts(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _ago(now: str, **part: int) -> Column:
    return _ts(now) - F.make_interval(**{k: F.lit(v) for k, v in part.items()})


def radar(items: DataFrame, sources: DataFrame, now: str) -> DataFrame:
    """One row: items of the last day, p1 and featured items, enabled sources, and the share of signal."""
    a = items.agg(F.count_if(F.col("created_at") >= _ago(now, hours=24)).alias("items_today"), F.count_if(F.col("tier") == "p1").alias("items_p1"), F.count_if(F.col("tier") == "featured").alias("items_featured"))
    b = sources.agg(F.count_if("enabled").alias("tracked_sources"))
    ratio = F.when(F.col("items_today") > 0, F.round((F.col("items_p1") + F.col("items_featured")) / F.col("items_today"), 6)).otherwise(0.72)
    return a.crossJoin(b).withColumn("signal_ratio", ratio)  # one row each


def pulse(items: DataFrame, now: str) -> DataFrame:
    """Items of the rolling last 24 hours by hour of day, all 24 hours."""
    spark = items.sparkSession
    got = items.where(F.col("created_at") >= _ago(now, hours=24)).groupBy(F.hour("created_at").alias("h")).agg(F.count("*").alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("h"))
    return hours.join(F.broadcast(got), "h", "left").select("h", F.coalesce("n", F.lit(0).cast("long")).alias("c"))  # 24 rows


def peak_hour(pulse: DataFrame) -> DataFrame:
    return pulse.agg(F.max("c").alias("peak"), F.max_by("h", F.struct(F.col("c"), -F.col("h"))).alias("peak_hour"), F.sum("c").alias("total"))


def top_topics(items: DataFrame, now: str, days: int = 7, limit: int = 16) -> DataFrame:
    bag = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("capabilities", "entities", "topics")])
    n = items.where((F.col("published_at") >= _ago(now, days=days)) & F.col("enriched_at").isNotNull()).select(F.explode(bag).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "tag").limit(limit)
    return top.withColumn("hot", F.col("n") >= F.max("n").over(Window.partitionBy()) * 0.6)  # `limit` rows


def day_counts(items: DataFrame, sources: DataFrame, clusters: DataFrame, now: str, days: int = 30, tier: str = "all", exclude_tags: tuple[str, ...] = (), include_tags: tuple[str, ...] = (), curated_only: bool = False) -> DataFrame:
    """Leads by day of the last days. A null tier counts as "all" here, unlike in the feed."""
    eff = F.coalesce("c_event_tier", "tier")
    test = {"p1": eff == "p1", "featured": eff.isin("featured", "p1"), "all": F.coalesce(eff, F.lit("all")) != "excluded"}[tier]
    rows = joined(items, sources, clusters).where(F.col("enriched_at").isNotNull() & F.col("importance").isNotNull() & test)
    rows = rows.where((F.col("cluster_id").isNull() | (F.col("c_lead_item_id") == F.col("id"))) & (F.col("published_at") >= _ago(now, days=days)))
    if exclude_tags:
        rows = rows.where(~overlaps("s_tags", exclude_tags))
    if include_tags:
        rows = rows.where(overlaps("s_tags", include_tags))
    if curated_only:
        rows = rows.where("s_curated")
    return rows.groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(days)


def calendar_heat(counts: DataFrame) -> DataFrame:
    """Intensity of each day against the busiest, at least 0.08, and its column in a week that begins on Monday."""
    peak = F.max("n").over(Window.partitionBy())  # days of a calendar
    return counts.select("day", "n", F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.08), F.round(F.col("n") / peak, 6))).alias("heat"), F.expr("weekday(to_date(day))").alias("column"))


TOKENS = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")


def _sums() -> list[Column]:
    return [F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in TOKENS], F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost")]


def usage_totals(usage: DataFrame, now: str) -> DataFrame:
    """Calls, tokens and cost of today, 7 days, 30 days and all time, in one scan."""
    starts = (("today", F.date_trunc("day", _ts(now)).cast("timestamp_ntz")), ("7d", _ago(now, days=7)), ("30d", _ago(now, days=30)), ("all", _ts("1970-01-01 00:00:00")))
    since = F.array(*[F.struct(F.lit(name).alias("span"), start.alias("since")) for name, start in starts])
    rows = usage.withColumn("s", F.explode(since)).where("created_at >= s.since").groupBy(F.col("s.span").alias("span")).agg(*_sums())
    spans = usage.sparkSession.createDataFrame([("today",), ("7d",), ("30d",), ("all",)], "span string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", *TOKENS, "cost")]
    return spans.join(F.broadcast(rows), "span", "left").select("span", *zero)  # four rows


def usage_by(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(*_sums()).orderBy(F.desc("cost"), *keys)


def daily_spend(usage: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Cost and calls of each of the last days, none left out."""
    last = F.date_trunc("day", _ts(now)).cast("timestamp_ntz")
    spine = usage.sparkSession.range(1).select(F.explode(F.expr(f"sequence(to_date('{now}') - {days - 1}, to_date('{now}'))")).alias("d"))
    got = usage.where(F.col("created_at") >= last - F.make_interval(days=F.lit(days - 1))).groupBy(F.to_date("created_at").alias("d")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))
    return spine.join(F.broadcast(got), "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("calls", F.lit(0).cast("long")).alias("calls"), F.coalesce(F.col("cost"), F.lit(0)).cast("double").alias("cost"))  # `days` rows


def usage_shares(usage: DataFrame, budget: float) -> DataFrame:
    """Each task's share of the cost and of its tokens, in percent, and how much of a budget all have used."""
    by = usage.groupBy("task").agg(F.sum("cost_usd").cast("double").alias("cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    every = Window.partitionBy()  # a row a task
    total, tokens = F.sum("cost").over(every), F.sum("tokens").over(every)
    return by.select("task", F.round(100 * F.col("cost") / total, 2).alias("cost_pct"), F.round(100.0 * F.col("tokens") / tokens, 2).alias("token_pct"), F.least(F.lit(100.0), F.round(100 * total / budget, 2)).alias("budget_pct"))


def recent(rows: DataFrame, limit: int, *cols: str) -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", *cols)


def feedback_counts(votes: DataFrame) -> DataFrame:
    """Votes by kind; the total leaves saves out."""
    return votes.agg(*[F.count_if(F.col("vote") == v).alias(v) for v in ("up", "down", "save")]).withColumn("total", F.col("up") + F.col("down"))


def saved_totals(votes: DataFrame, now: str) -> DataFrame:
    saves = votes.where("vote = 'save'")
    return saves.agg(F.count("*").alias("n_all"), F.count_if(F.col("created_at") > _ago(now, days=7)).alias("n_7d"), F.count_if(F.col("created_at") > _ago(now, days=30)).alias("n_30d"), F.count_if(F.col("collection_id").isNull()).alias("inbox"))


def saved_tags(votes: DataFrame, items: DataFrame, collection: int | None = None, limit: int = 12) -> DataFrame:
    """The most frequent tags of saved items, of one collection or of all."""
    saves = votes.where("vote = 'save'")
    if collection is not None:
        saves = saves.where(F.col("collection_id") == collection)
    bag = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("capabilities", "entities", "topics")])
    rows = saves.select("item_id").join(items.select(F.col("id").alias("item_id"), bag.alias("bag")), "item_id")
    return rows.select(F.explode("bag").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def source_status(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Service status of each enabled source: fetched and without failures is healthy, whatever its cadence."""
    h = health.select("source_id", "status", "consecutive_failures", "last_success_at")
    fails = F.coalesce("consecutive_failures", F.lit(0))
    status = F.when((F.col("status") == "error") | (fails >= 3), "error").when(fails >= 1, "degraded").when(F.col("last_success_at").isNotNull(), "healthy").otherwise("idle")
    rows = sources.where("enabled").join(F.broadcast(h), sources.id == h.source_id, "left")  # a row a source
    rank = F.expr("CASE service WHEN 'error' THEN 0 WHEN 'degraded' THEN 1 WHEN 'healthy' THEN 2 ELSE 3 END")
    return rows.select("id", "kind", status.alias("service"), F.coalesce("status", F.lit("pending")).alias("health"), fails.alias("failures")).withColumn("rank", rank).orderBy("rank", "id")


def status_counts(status: DataFrame) -> DataFrame:
    every = status.sparkSession.createDataFrame([("healthy",), ("degraded",), ("error",), ("idle",)], "service string")
    got = status.groupBy("service").agg(F.count("*").alias("c"))
    return every.join(F.broadcast(got), "service", "left").select("service", F.coalesce("c", F.lit(0).cast("long")).alias("n"))  # four rows


def queue_depths(items: DataFrame, raw: DataFrame) -> DataFrame:
    a = items.agg(F.count_if(F.col("enriched_at").isNull()).alias("unenriched"), F.count_if(F.col("tier").isin("featured", "p1") & F.col("commentary_at").isNull()).alias("uncommented"), F.count_if(F.col("enriched_at").isNotNull() & F.col("importance").isNull()).alias("unscored"))
    b = raw.agg(F.count_if(F.col("id") % 3 == 0).alias("pending_raw"))
    return a.crossJoin(b).withColumn("total", F.col("unenriched") + F.col("uncommented") + F.col("unscored") + F.col("pending_raw"))  # one row each


def source_counts(sources: DataFrame, items: DataFrame, health: DataFrame, now: str) -> DataFrame:
    """Items of the last day and of all time by source, sources without items included, with health."""
    n = items.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("created_at") >= _ago(now, hours=24)).alias("last_24h"))
    rows = sources.join(n, sources.id == n.source_id, "left").drop("source_id").join(F.broadcast(health.select("source_id", "status")), F.col("id") == F.col("source_id"), "left")
    zero = F.lit(0).cast("long")
    return rows.select("id", "grp", F.coalesce("total", zero).alias("total"), F.coalesce("last_24h", zero).alias("last_24h"), F.coalesce("status", F.lit("pending")).alias("status"))


def month_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy(F.date_format("published_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def cluster_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("n_items"), F.count("embedding").alias("n_embedded"), F.count_distinct("cluster_id").alias("n_clusters"))


def stage_counts(items: DataFrame, clusters: DataFrame) -> DataFrame:
    """Before and after a migration: how many rows each stage has left."""
    a = items.agg(F.count("*").alias("items"), F.count_if(F.col("cluster_id").isNull()).alias("unclustered"), F.count_if(F.col("tier") == "excluded").alias("excluded"))
    b = clusters.agg(F.count("*").alias("clusters"), F.count_if(F.col("member_count") > 1).alias("multi"), F.count_if(F.col("verified_at").isNull()).alias("unverified"), F.count_if(F.col("canonical_title_zh").isNull()).alias("untitled"))
    return a.crossJoin(b)  # one row each
