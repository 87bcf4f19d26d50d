"""News tables derived from the driver's Parquet tables, by exact expressions that any SQL engine can repeat.

The tables are plain DataFrames, so a query's filters and column choice reach the Parquet scans. `NOW` stands for the
current time everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.scoring import authority, event_importance, tier_of

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP_NTZ '{NOW}'"

KINDS = ("rss", "atom", "x-api", "rsshub", "api")
GROUPS = ("vendor-official", "media", "newsletter", "research", "social", "product", "podcast", "policy", "market")
CADENCES = ("hourly", "daily", "weekly")
LOCALES = ("en", "zh", "multi")
#: when the item of a document was published
PUBLISHED = f"({NOW_SQL} - make_interval(0, 0, 0, 0, CAST((doc_id * 37) % 720 AS INT), 0, 0))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a feed; a dimension of a few rows."""
    s = "s"
    base = table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct().select("source", F.expr("CAST(substring(source, 4) AS INT)").alias(s))
    return base.select(
        F.col("source").alias("id"),
        F.expr(_pick(KINDS, s)).alias("kind"),
        F.expr(_pick(GROUPS, s)).alias("grp"),
        F.expr(_pick(LOCALES, s)).alias("locale"),
        F.expr(_pick(CADENCES, s)).alias("cadence"),
        F.expr("CASE WHEN s % 5 = 0 THEN array('arxiv', 'paper') ELSE array('news', concat('t', s % 3)) END").alias("tags"),
        F.expr("s % 10 <> 9").alias("enabled"),
        F.expr("s % 4 = 0").alias("curated"),
        F.expr("s % 7 = 0").alias("never_exclude"),
        F.expr("1 + s % 3").alias("priority"),
        F.expr("concat('Source ', s)").alias("name_en"),
        F.expr("concat('源 ', s)").alias("name_zh"),
    )


def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text digest, least id and count for texts that occur more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def items(spark: SparkSession, sf_dir: str, clustered: bool = True, embedded: bool = False) -> DataFrame:
    """One row an item. Without `clustered`, cluster_id isn't there, and nothing is shuffled for it."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id"), "quality")
    rows = docs.join(labels, docs.doc_id == labels.l_id, "left")
    pub = PUBLISHED
    imp = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 31) % 101 AS INT) END"
    tier = f"CASE WHEN doc_id % 29 = 0 THEN NULL ELSE {tier_of(f'coalesce({imp}, 0)')} END"
    title = "left(substring_index(text, '\\n', 1), 120)"
    cols = [
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.expr(title).alias("title"),
        F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('标题 ', doc_id) END").alias("title_zh"),
        F.expr(f"CASE WHEN doc_id % 4 <> 0 THEN {title} END").alias("title_en"),
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN concat('摘要 ', doc_id) END").alias("summary_zh"),
        F.expr("left(text, 200)").alias("summary_en"),
        F.col("text").alias("body"), F.expr("CASE WHEN doc_id % 6 <> 0 THEN text END").alias("body_md"), "lang",
        F.expr("concat('https://', source, '.example.com/a/', doc_id)").alias("url"),
        F.expr(pub).alias("published_at"), F.expr(pub).alias("created_at"),
        F.expr(imp).alias("importance"), F.expr(f"CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {pub} END").alias("enriched_at"),
        F.expr(tier).alias("tier"), F.expr("doc_id % 2 = 0").alias("hkr_h"), F.expr("doc_id % 3 = 0").alias("hkr_k"), F.expr("coalesce(quality, 0) = 1").alias("hkr_r"),
        F.expr("CASE WHEN doc_id % 4 <> 0 THEN array(concat('cap', doc_id % 4)) END").alias("capabilities"),
        F.expr("array(concat('ent', doc_id % 11))").alias("entities"),
        F.expr("array(concat('topic', doc_id % 5), concat('topic', doc_id % 7))").alias("topics"),
        F.expr("CASE WHEN doc_id % 8 <> 0 THEN concat('注 ', doc_id) END").alias("editor_note_zh"),
        F.expr("CASE WHEN doc_id % 9 = 0 THEN concat('note ', doc_id) END").alias("editor_note_en"),
        F.expr(f"CASE WHEN doc_id % 9 = 0 THEN {pub} END").alias("commentary_at"),
        F.expr(f"CASE WHEN doc_id % 4 = 0 THEN {pub} END").alias("cluster_verified_at"),
    ]
    if clustered:
        keys = cluster_keys(spark, sf_dir)
        rows = rows.withColumn("digest", F.md5("text")).join(keys, "digest", "left")
        cols.append(F.expr("CASE WHEN copies > 1 THEN first_id WHEN doc_id % 2 = 0 THEN doc_id END").alias("cluster_id"))
    if embedded:
        vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
        rows = rows.join(vectors, rows.doc_id == vectors.vec_id, "left")
        cols += ["embedding", "label"]
    return rows.select(*cols)


def clusters_of(items: DataFrame, sources: DataFrame) -> DataFrame:
    """One row an event, from its members."""
    src = sources.select(F.col("id").alias("s_id"), "grp", "priority")
    members = items.where("cluster_id IS NOT NULL").join(F.broadcast(src), items.source_id == src.s_id)
    # the best lead: highest authority, then earliest, then least id
    rank = F.struct((-authority("grp", "priority", "importance")).alias("a"), F.col("published_at").alias("b"), F.col("id").alias("c"))
    agg = members.groupBy(F.col("cluster_id").alias("id")).agg(
        F.min_by(F.col("id"), rank).alias("lead_item_id"), F.count("*").alias("member_count"),
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("latest_member_at"),
        event_importance("importance").alias("imp"),
        F.expr("bool_or(hkr_h)").alias("any_h"), F.expr("bool_or(hkr_k)").alias("any_k"), F.expr("bool_or(hkr_r)").alias("any_r"),
    )
    multi = "member_count > 1"
    return agg.select(
        "id", "lead_item_id", "member_count", F.col("member_count").alias("coverage"), "first_seen_at", "latest_member_at",
        F.expr("CASE WHEN id % 5 <> 0 THEN concat('事件 ', id) END").alias("canonical_title_zh"),
        F.expr("CASE WHEN id % 5 <> 0 THEN concat('event ', id) END").alias("canonical_title_en"),
        F.expr(f"CASE WHEN {multi} THEN imp END").alias("importance"),
        F.expr(f"CASE WHEN {multi} THEN {tier_of('imp')} END").alias("event_tier"),
        *[F.expr(f"CASE WHEN {multi} THEN any_{x} END").alias(f"hkr_{x}") for x in "hkr"],
        F.expr("CASE WHEN id % 3 = 0 THEN concat('评 ', id) END").alias("editor_note_zh"),
        F.expr("CASE WHEN id % 4 = 0 THEN concat('comment ', id) END").alias("editor_note_en"),
        F.expr("CASE WHEN id % 2 = 1 THEN latest_member_at END").alias("verified_at"),
        F.expr("CASE WHEN id % 7 <> 0 THEN latest_member_at END").alias("titled_at"),
        F.expr("CASE WHEN id % 11 = 0 THEN latest_member_at END").alias("commentary_at"),
        F.expr("latest_member_at + make_interval(0, 0, 0, 0, CAST(id % 48 AS INT), 0, 0)").alias("updated_at"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters_of(items(spark, sf_dir), sources(spark, sf_dir))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages: url, payload, host as source_id."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("source_id"))


def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of model calls."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.expr("CASE WHEN event_id % 11 <> 0 THEN event_type END").alias("task"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'azure-openai' ELSE 'anthropic' END").alias("provider"),
        F.expr("concat('m', user_id % 4)").alias("model"),
        F.expr("event_id % 4000").alias("input_tokens"), F.expr("event_id % 900").alias("output_tokens"),
        F.expr("event_id % 500").alias("cached_input_tokens"), F.expr("event_id % 300").alias("reasoning_tokens"),
        F.expr("CASE WHEN event_id % 19 <> 0 THEN CAST(value AS DECIMAL(12, 6)) END").alias("cost_usd"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes as they were cast, in time order by event_id."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    votes = table(spark, sf_dir, "events").where("event_type IN ('click', 'error', 'purchase')").crossJoin(F.broadcast(n))  # one row
    return votes.select(
        F.col("event_id").alias("id"), F.expr("event_id % n_docs").alias("item_id"), "user_id",
        F.expr("CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'save' END").alias("vote"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN 1 + event_id % 4 END").alias("collection_id"), F.col("ts").alias("created_at"),
        F.expr("event_id % 4 <> 3").alias("on"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, one for each item, user and kind of vote: the first."""
    rows = feedback_events(spark, sf_dir)
    return rows.groupBy("item_id", "user_id", "vote").agg(F.min(F.struct("id", "collection_id", "created_at")).alias("f")).select("f.id", "item_id", "user_id", "vote", "f.collection_id", "f.created_at")


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of the fetched sources; those with s % 6 = 5 were never fetched."""
    rows = sources(spark, sf_dir).select("id", F.expr("CAST(substring(id, 4) AS INT)").alias("s")).where("s % 6 <> 5")
    return rows.select(
        F.col("id").alias("source_id"), F.expr("CASE s % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'pending' END").alias("status"),
        F.expr("s % 5").alias("consecutive_failures"), F.expr("s * 10").alias("total_items_count"),
        F.expr(f"CASE WHEN s % 3 <> 0 THEN {NOW_SQL} - make_interval(0, 0, 0, 0, s, 0, 0) END").alias("last_success_at"),
        F.expr(f"{NOW_SQL} - make_interval(0, 0, 0, 0, 0, s, 0)").alias("last_fetched_at"),
    )
