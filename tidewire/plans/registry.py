"""Registered queries and their DuckDB SQL: the feed, counts, events, digests, streams. Intake and upkeep register theirs beside these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import cluster, digest, feed, feedback, pricing, snapshots, stats, vectors
from tidewire.plans.base import AGO, DAY, QUERIES, SQL, add
from tidewire.plans.views import NOW, Views, tier
from tidewire.sources import archive
from tidewire.sources import fixtures as fx
from tidewire.sources.shared import cut, shared_dir
from tidewire.streaming import jobs

# -- the feed ---------------------------------------------------------------------------------------------------------

STORY = "id long, source_id string, publisher string, kind string, grp string, featured boolean, title string, summary string, tags string, importance int, tier string, published_at string, url string, editor_note string, hkr_h boolean, hkr_k boolean, hkr_r boolean, cluster_id long, coverage long, cross_source_count long, still_developing boolean"


def story(source: str, locale: str = "en") -> str:
    a, b = ("en", "zh") if locale == "en" else ("zh", "en")
    return f"""SELECT id, source_id, s_name_{a} AS publisher, s_kind AS kind, s_grp AS grp, coalesce(eff_tier, 'all') IN ('featured', 'p1') AS featured, coalesce(c_t{a}, title_{a}, title_{b}, title) AS title, coalesce(summary_{a}, summary_{b}, '') AS summary,
        array_to_string(list_slice(list_concat(list_concat(capabilities, entities), topics), 1, 4), ',') AS tags, coalesce(eff, 0) AS importance, coalesce(eff_tier, 'all') AS tier, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, url,
        coalesce(c_n{a}, c_n{b}, editor_note_{a}, editor_note_{b}) AS editor_note, coalesce(c_h, hkr_h) AS hkr_h, coalesce(c_k, hkr_k) AS hkr_k, coalesce(c_r, hkr_r) AS hkr_r, cluster_id,
        CASE WHEN c_n > 1 THEN c_n END AS coverage, CASE WHEN c_n > 1 THEN c_n - 1 END AS cross_source_count, c_first < date_trunc('day', {NOW}) AND c_last > {NOW} - INTERVAL 24 HOURS AS still_developing FROM ({source})"""


BASE = "enriched_at IS NOT NULL AND importance IS NOT NULL AND (cluster_id IS NULL OR c_lead = id)"
FEATURED, ALL, P1 = "eff_tier IN ('featured', 'p1')", "eff_tier <> 'excluded'", "eff_tier = 'p1'"


def page(test: str, limit: int = 40, offset: int = 0) -> str:
    return f"SELECT * FROM j WHERE {BASE} AND {test} ORDER BY published_at DESC, eff DESC, id DESC LIMIT {limit} OFFSET {offset}"


def add_feed(name: str, test: str, locale: str = "en", **parts) -> None:
    add(name, STORY, lambda v: v.feed(locale=locale, **parts), story(page(test, parts.get("limit", 40), parts.get("offset", 0)), locale), "j")


TEXT = " OR ".join(f"coalesce({c} ILIKE '%{{0}}%', false)" for c in ("title", "title_zh", "title_en", "summary_zh", "summary_en", "c_tzh", "c_ten"))
PAPERS = "list_has_any(s_tags, ['arxiv', 'paper'])"

add_feed("feed_archive", FEATURED)
add_feed("feed_archive_zh", FEATURED, locale="zh")
add_feed("feed_p1", P1, tier="p1")
add_feed("feed_today", f"{ALL} AND (coalesce(c_first >= {DAY}, false) OR coalesce(c_last > {NOW} - INTERVAL 24 HOURS, false) OR published_at >= {DAY} - INTERVAL 1 DAY)", tier="all", view="today")
add_feed("feed_day", f"{ALL} AND published_at >= TIMESTAMP '2024-01-20' AND published_at < TIMESTAMP '2024-01-21'", tier="all", date="2024-01-20")
add_feed("feed_date_range", f"{ALL} AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-01-15'", tier="all", date_from="2024-01-10", date_to="2024-01-15", limit=200)
add_feed("feed_by_source", f"{ALL} AND source_id = 'src3'", tier="all", source_id="src3")
add_feed("feed_by_group", f"{ALL} AND s_grp = 'podcast'", tier="all", source_group="podcast")
add_feed("feed_by_kind", f"{ALL} AND s_kind = 'x-api'", tier="all", source_kind="x-api")
add_feed("feed_page_3", ALL, tier="all", limit=20, offset=40)
add_feed("lexical_search", f"{ALL} AND ({TEXT.format('event 1')})", tier="all", search="event 1")
add_feed("lexical_search_wildcard", f"{ALL} AND ({TEXT.format('t_e%an')})", tier="all", search="t_e%an", limit=100)
add_feed("curated_feed", f"{ALL} AND s_curated", tier="all", curated_only=True)
add_feed("papers_feed", f"{ALL} AND {PAPERS}", tier="all", include_tags=feed.tag_list(" arxiv, paper,,"))
add_feed("news_feed", f"{FEATURED} AND NOT {PAPERS}", exclude_tags=("arxiv", "paper"))
HOME = f"{FEATURED} AND NOT {PAPERS} AND (eff >= 80 OR published_at >= {DAY} - INTERVAL 2 DAY)"
add(
    "home_daily_highlights",
    STORY,
    lambda v: v.feed(exclude_tags=("arxiv", "paper"), min_importance=80, rescue_days=3, max_per_day=3, limit=40),
    story(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strftime(published_at, '%Y-%m-%d') ORDER BY eff DESC, published_at DESC, id DESC) AS k FROM
        (SELECT * FROM j WHERE {BASE} AND {HOME} ORDER BY strftime(published_at, '%Y-%m-%d') DESC, eff DESC, published_at DESC, id DESC LIMIT 200)) WHERE k <= 3
        ORDER BY strftime(published_at, '%Y-%m-%d') DESC, eff DESC, published_at DESC, id DESC LIMIT 40"""),
    "j",
)
add("feed_count", "total long", lambda v: feed.feed_count(v.items, v.sources, v.clusters, feed.FeedQuery(now=fx.NOW, tier="all")), f"SELECT count(*) AS total FROM j WHERE {BASE} AND {ALL}", "j")
add(
    "event_badge",
    "cluster_id long, badge string",
    lambda v: feed.event_badge(v.clusters, fx.NOW),
    f"""SELECT id AS cluster_id, CASE WHEN member_count <= 1 THEN NULL WHEN first_seen_at >= {DAY} THEN 'NEW·' || member_count
        ELSE 'dev·' || greatest(1, CAST(floor(epoch_us({NOW}) / 86400000000.0 - epoch_us(first_seen_at) / 86400000000.0) AS INT)) || 'd' END AS badge FROM clusters""",
    "clusters",
)

# -- counts and roll-ups ----------------------------------------------------------------------------------------------

add(
    "radar_stats",
    "items_today long, items_p1 long, items_featured long, tracked_sources long, signal_ratio double",
    lambda v: stats.radar(v.plain, v.sources, fx.NOW),
    f"""SELECT *, CASE WHEN items_today > 0 THEN round((items_p1 + items_featured) / items_today, 6) ELSE 0.72 END AS signal_ratio FROM
        (SELECT count(*) FILTER (created_at >= {AGO("24 HOURS")}) AS items_today, count(*) FILTER (tier = 'p1') AS items_p1, count(*) FILTER (tier = 'featured') AS items_featured FROM items), (SELECT count(*) FILTER (enabled) AS tracked_sources FROM sources)""",
    "items",
    "sources",
)
PULSE = f"SELECT h, count(id) AS c FROM range(24) r(h) LEFT JOIN (SELECT * FROM items WHERE created_at >= {AGO('24 HOURS')}) ON hour(created_at) = h GROUP BY h"
add("pulse", "h int, c long", lambda v: stats.pulse(v.plain, fx.NOW), PULSE, "items")
add("peak_hour", "peak long, peak_hour int, total long", lambda v: stats.peak_hour(stats.pulse(v.plain, fx.NOW)), f"SELECT max(c) AS peak, first(h ORDER BY c DESC, h) AS peak_hour, sum(c) AS total FROM ({PULSE})", "items")
BAG = "unnest(list_concat(list_concat(capabilities, entities), topics))"
add(
    "top_topics",
    "tag string, n long, hot boolean",
    lambda v: stats.top_topics(v.plain, fx.NOW),
    f"SELECT tag, n, n >= 0.6 * max(n) OVER () AS hot FROM (SELECT tag, count(*) AS n FROM (SELECT {BAG} AS tag FROM items WHERE published_at >= {AGO('7 DAYS')} AND enriched_at IS NOT NULL) GROUP BY tag ORDER BY n DESC, tag LIMIT 16)",
    "items",
)
COUNTS = f"SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS n FROM j WHERE {BASE} AND coalesce(eff_tier, 'all') <> 'excluded' AND published_at >= {AGO('30 DAYS')} GROUP BY day ORDER BY day DESC LIMIT 30"
add("day_counts", "day string, n long", lambda v: stats.day_counts(v.items, v.sources, v.clusters, fx.NOW), COUNTS, "j")
add(
    "day_counts_papers",
    "day string, n long",
    lambda v: stats.day_counts(v.items, v.sources, v.clusters, fx.NOW, days=14, tier="featured", include_tags=("arxiv", "paper")),
    f"SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS n FROM j WHERE {BASE} AND {FEATURED} AND {PAPERS} AND published_at >= {AGO('14 DAYS')} GROUP BY day ORDER BY day DESC LIMIT 14",
    "j",
)
add(
    "calendar_heat",
    "day string, n long, heat double, column int",
    lambda v: stats.calendar_heat(stats.day_counts(v.items, v.sources, v.clusters, fx.NOW)),
    f'SELECT day, n, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.08, round(n / max(n) OVER (), 6)) END AS heat, (isodow(CAST(day AS DATE)) - 1) AS "column" FROM ({COUNTS})',
    "j",
)
SQL["calendar_heat"] = SQL["calendar_heat"].replace("CAST(column AS INTEGER) AS column", 'CAST("column" AS INTEGER) AS "column"')
SUMS = "count(*) AS calls, " + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in stats.TOKENS) + ", coalesce(sum(cost_usd), 0) AS cost"
USAGE = "calls long, input_tokens long, output_tokens long, cached_input_tokens long, reasoning_tokens long, cost double"
add(
    "usage_totals",
    f"span string, {USAGE}",
    lambda v: stats.usage_totals(v.usage, fx.NOW),
    " UNION ALL ".join(f"SELECT '{s}' AS span, {SUMS} FROM usage WHERE created_at >= {since}" for s, since in (("today", DAY), ("7d", AGO("7 DAYS")), ("30d", AGO("30 DAYS")), ("all", "TIMESTAMP '1970-01-01'"))),
    "usage",
)
add("usage_by_task", f"task string, {USAGE}", lambda v: stats.usage_by(v.usage, "task"), f"SELECT task, {SUMS} FROM usage GROUP BY task", "usage")
add("usage_by_model", f"provider string, model string, {USAGE}", lambda v: stats.usage_by(v.usage, "provider", "model"), f"SELECT provider, model, {SUMS} FROM usage GROUP BY provider, model", "usage")
add(
    "daily_spend",
    "day string, calls long, cost double",
    lambda v: stats.daily_spend(v.usage, fx.NOW),
    f"SELECT strftime(d, '%Y-%m-%d') AS day, count(id) AS calls, coalesce(sum(cost_usd), 0) AS cost FROM (SELECT unnest(generate_series({DAY} - INTERVAL 29 DAYS, {DAY}, INTERVAL 1 DAY)) AS d) LEFT JOIN usage ON date_trunc('day', created_at) = d GROUP BY d",
    "usage",
)
add(
    "usage_shares",
    "task string, cost_pct double, token_pct double, budget_pct double",
    lambda v: stats.usage_shares(v.usage, 1_000_000.0),
    """SELECT task, round(100 * cost / sum(cost) OVER (), 2) AS cost_pct, round(100.0 * tokens / sum(tokens) OVER (), 2) AS token_pct, least(100.0, round(100 * (sum(cost) OVER ()) / 1000000.0, 2)) AS budget_pct
       FROM (SELECT task, CAST(sum(cost_usd) AS DOUBLE) AS cost, sum(input_tokens + output_tokens) AS tokens FROM usage GROUP BY task)""",
    "usage",
)
add("recent_calls", "id long, task string, model string", lambda v: stats.recent(v.usage, 25, "task", "model"), "SELECT id, task, model FROM usage ORDER BY created_at DESC, id DESC LIMIT 25", "usage")
add("feedback_counts", "up long, down long, save long, total long", lambda v: stats.feedback_counts(v.votes), "SELECT count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down, count(*) FILTER (vote = 'save') AS save, count(*) FILTER (vote <> 'save') AS total FROM votes", "votes")
add(
    "saved_totals",
    "n_all long, n_7d long, n_30d long, inbox long",
    lambda v: stats.saved_totals(v.votes, fx.NOW),
    f"SELECT count(*) AS n_all, count(*) FILTER (created_at > {AGO('7 DAYS')}) AS n_7d, count(*) FILTER (created_at > {AGO('30 DAYS')}) AS n_30d, count(*) FILTER (collection_id IS NULL) AS inbox FROM votes WHERE vote = 'save'",
    "votes",
)
add("saved_tags", "tag string, n long", lambda v: stats.saved_tags(v.votes, v.plain), f"SELECT tag, count(*) AS n FROM (SELECT {BAG} AS tag FROM votes v JOIN items i ON v.item_id = i.id WHERE vote = 'save') GROUP BY tag ORDER BY n DESC, tag LIMIT 12", "votes", "items")
add(
    "collection_counts",
    "user_id long, collection_id long, n long, pinned boolean, place int",
    lambda v: feedback.collections(v.votes),
    """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pinned DESC, collection_id DESC) AS place FROM
       (SELECT user_id, collection_id, count(*) AS n, collection_id = 1 AS pinned FROM votes WHERE vote = 'save' AND collection_id IS NOT NULL GROUP BY user_id, collection_id)""",
    "votes",
)
add("current_votes", "item_id long, user_id long, up boolean, down boolean, save boolean", lambda v: feedback.current_votes(v.votes), "SELECT item_id, user_id, bool_or(vote = 'up') AS up, bool_or(vote = 'down') AS down, bool_or(vote = 'save') AS save FROM votes GROUP BY item_id, user_id", "votes")
add(
    "toggle_fold",
    "item_id long, user_id long, vote string, id long",
    lambda v: feedback.fold_toggles(v.toggles),
    """SELECT item_id, user_id, vote, id FROM (SELECT item_id, user_id, vote, max(id) AS id, first(switched ORDER BY id DESC) AS last_on FROM toggles GROUP BY item_id, user_id, vote) t
       WHERE last_on AND NOT EXISTS (SELECT 1 FROM toggles o WHERE o.item_id = t.item_id AND o.user_id = t.user_id AND o.switched AND o.vote <> 'save' AND t.vote <> 'save' AND o.vote <> t.vote
         AND o.id > (SELECT max(x.id) FROM toggles x WHERE x.item_id = t.item_id AND x.user_id = t.user_id AND x.vote = t.vote AND x.switched))""",
    "toggles",
)
add(
    "saved_items",
    "feedback_id long, item_id long, user_id long, title string, name_en string, tags string",
    lambda v: feedback.saved(v.votes, v.items, v.sources, v.clusters),
    """SELECT v.id AS feedback_id, item_id, user_id, coalesce(c_ten, title_en, title) AS title, s_name_en AS name_en, array_to_string(list_slice(list_concat(list_concat(capabilities, entities), topics), 1, 6), ',') AS tags
       FROM votes v JOIN j ON v.item_id = j.id WHERE vote = 'save' ORDER BY v.created_at DESC, v.id DESC LIMIT 50""",
    "votes",
    "j",
)
add("recent_feedback", "feedback_id long, item_id long, vote string, title string", lambda v: feedback.recent_votes(v.votes, v.plain), "SELECT v.id AS feedback_id, item_id, vote, title FROM votes v JOIN items i ON v.item_id = i.id WHERE vote <> 'save' ORDER BY v.created_at DESC, v.id DESC LIMIT 20", "votes", "items")
STATUS = """SELECT s.id, kind, CASE WHEN status = 'error' OR coalesce(consecutive_failures, 0) >= 3 THEN 'error' WHEN coalesce(consecutive_failures, 0) >= 1 THEN 'degraded' WHEN last_success_at IS NOT NULL THEN 'healthy' ELSE 'idle' END AS service,
    coalesce(status, 'pending') AS health, coalesce(consecutive_failures, 0) AS failures FROM sources s LEFT JOIN health h ON s.id = h.source_id WHERE enabled"""
add("source_health_status", "id string, kind string, service string, health string, failures int", lambda v: stats.source_status(v.sources, v.health), STATUS, "health")
add("source_status_counts", "service string, n long", lambda v: stats.status_counts(stats.source_status(v.sources, v.health)), f"SELECT service, count(id) AS n FROM (SELECT unnest(['healthy', 'degraded', 'error', 'idle']) AS service) LEFT JOIN ({STATUS}) USING (service) GROUP BY service", "health")
add(
    "queue_depths",
    "unenriched long, uncommented long, unscored long, pending_raw long, total long",
    lambda v: stats.queue_depths(v.plain, v.raw),
    """SELECT *, unenriched + uncommented + unscored + pending_raw AS total FROM (SELECT count(*) FILTER (enriched_at IS NULL) AS unenriched, count(*) FILTER (tier IN ('featured', 'p1') AND commentary_at IS NULL) AS uncommented,
       count(*) FILTER (enriched_at IS NOT NULL AND importance IS NULL) AS unscored FROM items), (SELECT count(*) FILTER (id % 3 = 0) AS pending_raw FROM raw)""",
    "items",
    "raw",
)
add(
    "source_counts",
    "id string, grp string, total long, last_24h long, status string",
    lambda v: stats.source_counts(v.sources, v.plain, v.health, fx.NOW),
    f"""SELECT s.id, grp, coalesce(total, 0) AS total, coalesce(last_24h, 0) AS last_24h, coalesce(status, 'pending') AS status FROM sources s LEFT JOIN health h ON s.id = h.source_id
        LEFT JOIN (SELECT source_id, count(*) AS total, count(*) FILTER (created_at >= {AGO("24 HOURS")}) AS last_24h FROM items GROUP BY source_id) n ON s.id = n.source_id""",
    "items",
    "health",
)
add("month_histogram", "month string, n long", lambda v: stats.month_histogram(v.plain), "SELECT strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM items GROUP BY month", "items")
add("cluster_counts", "n_items long, n_embedded long, n_clusters long", lambda v: stats.cluster_counts(v.vectors), "SELECT count(*) AS n_items, count(embedding) AS n_embedded, count(DISTINCT cluster_id) AS n_clusters FROM items", "items")
add(
    "stage_counts",
    "items long, unclustered long, excluded long, clusters long, multi long, unverified long, untitled long",
    lambda v: stats.stage_counts(v.items, v.clusters),
    """SELECT * FROM (SELECT count(*) AS items, count(*) FILTER (cluster_id IS NULL) AS unclustered, count(*) FILTER (tier = 'excluded') AS excluded FROM items),
       (SELECT count(*) AS clusters, count(*) FILTER (member_count > 1) AS multi, count(*) FILTER (verified_at IS NULL) AS unverified, count(*) FILTER (canonical_title_zh IS NULL) AS untitled FROM clusters)""",
    "clusters",
)

# -- vectors and events -----------------------------------------------------------------------------------------------

DIST = "round(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6)"
NEAR = f"""near AS (SELECT a.id, b.id AS o_id, a.cluster_id, b.cluster_id AS o_cluster_id, a.source_id, b.source_id AS o_source_id, {DIST} AS distance FROM items a JOIN items b
    ON a.id <> b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 72 * 3600000000),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, o_id) AS rank FROM near)"""


def with_near(body: str) -> str:
    return f"SELECT * FROM (WITH {NEAR} {body})"


add("knn_pairs", "id long, o_id long, distance double, rank int", lambda v: vectors.neighbours(v.vectors, 72, 3), with_near("SELECT id, o_id, distance, rank FROM ranked WHERE rank <= 3"), "items")
NEW = "SELECT id, o_id AS other_id, distance, source_id <> o_source_id AS cross_source FROM ranked WHERE rank <= 3 AND id < o_id AND distance <= 0.8 AND cluster_id IS DISTINCT FROM o_cluster_id"
add("backtest_new_merges", "id long, other_id long, distance double, cross_source boolean", lambda v: cluster.new_merges(v.vectors, 0.8), with_near(NEW), "items")
EDGES = (0.0, 0.6, 0.65, 0.7, 0.75, 0.8)
add(
    "distance_histogram",
    "bucket int, n long, n_cross long",
    lambda v: cluster.histogram(cluster.new_merges(v.vectors, 0.8), EDGES),
    with_near("SELECT bucket, count(*) AS n, count(*) FILTER (cross_source) AS n_cross FROM (SELECT *, CASE " + " ".join(f"WHEN distance >= {a} AND distance < {b} THEN {i}" for i, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))) + f" END AS bucket FROM ({NEW})) WHERE bucket IS NOT NULL GROUP BY bucket"),
    "items",
)
add(
    "stage_a_assign",
    "id long, action string, target long, distance double",
    lambda v: cluster.assign(v.vectors, distance=0.75),
    with_near("""SELECT i.id, CASE WHEN c.o_id IS NOT NULL THEN 'join' WHEN u.o_id IS NOT NULL THEN 'new' ELSE 'single' END AS action, coalesce(c.o_cluster_id, u.o_id) AS target, coalesce(c.distance, u.distance) AS distance
        FROM items i LEFT JOIN (SELECT * FROM near WHERE distance <= 0.75 AND o_cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, o_id) = 1) c ON i.id = c.id
        LEFT JOIN (SELECT * FROM near WHERE distance <= 0.75 AND o_cluster_id IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, o_id) = 1) u ON i.id = u.id
        WHERE i.embedding IS NOT NULL AND i.cluster_id IS NULL AND i.enriched_at IS NOT NULL"""),
    "items",
)


def _placed(v: Views) -> DataFrame:
    members = cut(v.vectors.where("cluster_id IS NOT NULL").select("id", "cluster_id", "published_at", "embedding"))
    return jobs.placed(jobs.pending_items(v.spark, v.sf_dir, members), members, distance=0.75)


add(
    "stream_placed",
    "id long, event long, distance double",
    _placed,
    with_near("""SELECT i.id, c.o_cluster_id AS event, c.distance FROM items i
        LEFT JOIN (SELECT * FROM near WHERE distance <= 0.75 AND o_cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, o_id) = 1) c ON i.id = c.id
        WHERE i.embedding IS NOT NULL AND i.cluster_id IS NULL AND i.enriched_at IS NOT NULL"""),
    "items",
)

add(
    "arbitration_candidates",
    "id long, member_count long, updated_at string",
    lambda v: cluster.arbitration_candidates(v.clusters, v.items),
    """SELECT id, member_count, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM clusters c WHERE member_count >= 2 AND (verified_at IS NULL OR EXISTS (SELECT 1 FROM items i WHERE i.cluster_id = c.id AND i.cluster_verified_at IS NULL))
       ORDER BY c.member_count DESC, c.updated_at DESC, c.id LIMIT 15""",
    "clusters",
)


def verdicts(v: Views) -> DataFrame:
    """Splits as an arbiter could give them: every third event of two or more rejects its greatest member and a stranger."""
    members = v.items.where("cluster_id % 3 = 0").groupBy("cluster_id").agg(F.max("id").alias("m"), F.count("*").alias("n")).where("n > 1")
    return members.select("cluster_id", F.array(F.col("m"), F.lit(-1)).alias("rejected"), F.lit("other event").alias("reason"))


add(
    "split_apply",
    "item_id long, from_cluster_id long, reason string",
    lambda v: cluster.apply_splits(v.items, verdicts(v))[1],
    "SELECT max(id) AS item_id, cluster_id AS from_cluster_id, 'other event' AS reason FROM items WHERE cluster_id % 3 = 0 GROUP BY cluster_id HAVING count(*) > 1",
    "items",
)
MERGE = """SELECT * FROM (SELECT ca.id AS cluster_a, cb.id AS cluster_b, ca.member_count AS size_a, cb.member_count AS size_b, min(d) AS min_distance, round(avg(d), 6) AS mean_distance, count(*) FILTER (d <= 0.95) AS pairs_within, count(*) AS total_pairs FROM
    (SELECT a.cluster_id AS x, b.cluster_id AS y, {dist} AS d FROM items a JOIN items b ON a.cluster_id < b.cluster_id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 72 * 3600000000) p
    JOIN clusters ca ON p.x = ca.id JOIN clusters cb ON p.y = cb.id WHERE ca.member_count >= 2 AND cb.member_count >= 2 AND ca.canonical_title_zh IS NOT NULL AND cb.canonical_title_zh IS NOT NULL GROUP BY ALL)
    WHERE min_distance <= 0.95 AND mean_distance <= 1.0 AND pairs_within / total_pairs >= 0.5""".format(dist=DIST)
merges = lambda v: cluster.merge_candidates(v.clusters, v.vectors, least=0.95, mean=1.0)  # noqa: E731  the test vectors lie far apart
add("merge_candidates", "cluster_a long, cluster_b long, size_a long, size_b long, min_distance double, mean_distance double, pairs_within long, total_pairs long", merges, MERGE, "clusters")
add(
    "merge_components",
    "cluster_id long, survivor long",
    lambda v: cluster.survivors(merges(v)),
    f"""SELECT * FROM (WITH RECURSIVE m AS ({MERGE}), e AS (SELECT cluster_a AS a, cluster_b AS b FROM m UNION SELECT cluster_b, cluster_a FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT a AS cluster_id, min(b) AS survivor FROM r GROUP BY a)""",
    "clusters",
)
IMP = f"SELECT cluster_id, least(max(coalesce(importance, 0)) + CAST(round(log2(1 + count(*)) * 6) AS INT), 100) AS importance, bool_or(hkr_h) AS hkr_h, bool_or(hkr_k) AS hkr_k, bool_or(hkr_r) AS hkr_r, count(*) AS members FROM items WHERE cluster_id IS NOT NULL GROUP BY cluster_id"
add("event_scores", "cluster_id long, importance int, event_tier string, hkr_h boolean, hkr_k boolean, hkr_r boolean, members long", lambda v: cluster.event_scores(v.items), f"SELECT *, {tier('importance')} AS event_tier FROM ({IMP})", "items")
add("lead_pick", "cluster_id long, lead_item_id long", lambda v: cluster.leads(v.items, v.sources), "SELECT id AS cluster_id, lead_item_id FROM clusters", "clusters")
add(
    "richest_member",
    "cluster_id long, item_id long, body_md5 string",
    lambda v: cluster.richest(v.items),
    "SELECT cluster_id, id AS item_id, md5(left(coalesce(body_md, ''), 8000)) AS body_md5 FROM items WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(length(body_md), 0) DESC, id) = 1",
    "items",
)
add("cluster_rollup", "cluster_id long, member_count long, first_seen_at string, latest_member_at string", lambda v: cluster.rollup(v.items), "SELECT id AS cluster_id, member_count, strftime(first_seen_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(latest_member_at, '%Y-%m-%d %H:%M:%S') AS latest_member_at FROM clusters", "clusters")
add(
    "event_members",
    "cluster_id long, id long, name_en string, importance int, place int",
    lambda v: cluster.members(v.items, v.sources),
    "SELECT cluster_id, id, s_name_en AS name_en, importance, row_number() OVER (PARTITION BY cluster_id ORDER BY importance DESC NULLS LAST, published_at, id) AS place FROM j WHERE c_n > 1",
    "j",
)
add("title_candidates", "id long, member_count long", lambda v: cluster.title_candidates(v.clusters), "SELECT id, member_count FROM clusters WHERE member_count >= 2 AND (canonical_title_zh IS NULL OR titled_at IS NULL OR updated_at > titled_at) ORDER BY member_count DESC, updated_at DESC, id LIMIT 15", "clusters")
add("commentary_candidates", "id long, importance int, event_tier string", lambda v: cluster.commentary_candidates(v.clusters), "SELECT id, importance, event_tier FROM clusters WHERE event_tier IN ('featured', 'p1') AND member_count >= 2 AND commentary_at IS NULL ORDER BY importance DESC NULLS LAST, updated_at DESC, id LIMIT 8", "clusters")
add(
    "commentary_backlog",
    "id long, tier string, rank int",
    lambda v: cluster.commentary_backlog(v.items, v.clusters),
    "SELECT id, tier, CASE tier WHEN 'p1' THEN 0 ELSE 1 END AS rank FROM j WHERE commentary_at IS NULL AND enriched_at IS NOT NULL AND tier IN ('featured', 'p1') AND (cluster_id IS NULL OR coalesce(c_n, 1) < 2) ORDER BY rank, published_at DESC, id LIMIT 200",
    "j",
)

# -- digests and queues -----------------------------------------------------------------------------------------------

def pool_sql(now: str) -> str:
    """digest.daily_pool() of the window that `now` falls in."""
    return f"""SELECT * FROM (WITH w AS (SELECT * FROM j WHERE published_at >= date_trunc('hour', {now}) - INTERVAL 24 HOURS AND published_at < date_trunc('hour', {now}) AND NOT {PAPERS} AND enriched_at IS NOT NULL),
        b AS (SELECT id, 0 AS pool FROM w WHERE s_curated UNION ALL SELECT * FROM (SELECT id, 1 AS pool FROM w ORDER BY importance DESC NULLS LAST, published_at DESC, id LIMIT 25)),
        o AS (SELECT w.*, p.pool FROM w JOIN (SELECT id, min(pool) AS pool FROM b GROUP BY id) p ON w.id = p.id),
        f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(cluster_id, -1 - id) ORDER BY pool, importance DESC NULLS LAST, published_at DESC, id) AS k FROM o),
        t AS (SELECT * FROM f WHERE k = 1 ORDER BY pool, importance DESC NULLS LAST, published_at DESC, id LIMIT 20)
        SELECT id, cluster_id, importance, pool = 0 AS from_curated FROM t WHERE (SELECT count(*) FROM t) >= 5)"""


add("daily_pool", "id long, cluster_id long, importance int, from_curated boolean", lambda v: digest.daily_pool(v.items, v.sources, fx.NOW), pool_sql(NOW), "j")


def _pools(v: Views) -> DataFrame:
    """Three runs, two of them within one hour."""
    folder = f"{shared_dir(v.spark)}/pools-{uuid.uuid4().hex}"
    items = v.items.select("id", "cluster_id", "source_id", "importance", "published_at", "enriched_at")
    for now in ("2024-01-30 00:07:00", "2024-01-31 00:05:00", "2024-01-31 00:37:00"):
        pools = digest.written_pool(items, v.sources, now, folder)
    return pools.withColumnRenamed("window", "until")


add(
    "digest_runs",
    "until string, id long, cluster_id long, importance int, from_curated boolean",
    _pools,
    f"""SELECT '2024-01-30-00' AS until, * FROM ({pool_sql(f"{NOW} - INTERVAL 1 DAY")}) UNION ALL SELECT '2024-01-31-00', * FROM ({pool_sql(NOW)})""",
    "j",
)
add(
    "newsletter_top",
    "id long, importance int",
    lambda v: digest.newsletter(v.plain, fx.NOW),
    f"SELECT id, importance FROM items WHERE enriched_at IS NOT NULL AND importance IS NOT NULL AND published_at >= {DAY} - INTERVAL 30 DAYS AND published_at < {DAY} ORDER BY importance DESC, published_at DESC, id LIMIT 75",
    "items",
)
add(
    "ticker",
    "id long, lab string, val string, kind string, extra string",
    lambda v: digest.ticker(v.plain, v.sources, fx.NOW),
    f"""SELECT id, left(upper(name_en), 20) AS lab, CASE WHEN length(t) <= 44 THEN t ELSE rtrim(left(t, 43)) || '…' END AS val, CASE WHEN tier = 'p1' THEN 'hot' WHEN importance >= 90 THEN 'up' END AS kind, CAST(importance AS VARCHAR) AS extra FROM
        (SELECT i.*, name_en, coalesce(title_en, title_zh, title) AS t FROM items i JOIN sources s ON i.source_id = s.id WHERE created_at >= {AGO("24 HOURS")} AND importance IS NOT NULL AND tier IN ('featured', 'p1') ORDER BY importance DESC, i.id DESC LIMIT 12)""",
    "items",
    "sources",
)
LANE = "SELECT i.id, title, url, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM items i JOIN sources s ON i.source_id = s.id WHERE {} ORDER BY i.published_at DESC, i.id DESC LIMIT 50"
for lane, test in (("today", f"NOT list_has_any(tags, ['arxiv', 'paper']) AND i.published_at >= date_trunc('day', {NOW} - INTERVAL 1 DAY)"), ("curated", "curated"), ("papers", "list_has_any(tags, ['arxiv', 'paper'])")):
    add(f"rss_{lane}", "id long, title string, url string, published_at string", lambda v, lane=lane: digest.rss_lane(v.plain, v.sources, lane, fx.NOW), LANE.format(test), "items", "sources")
add("feed_rss_fallback", STORY, lambda v: digest.with_fallback(v.feed(search="no such words", limit=50), v.feed(tier="all", limit=50)), story(page(ALL, 50)), "j")
add("enrich_queue", "id long, rank int", lambda v: digest.enrich_queue(v.plain), "SELECT id, CASE WHEN length(body_md) >= 400 THEN 0 WHEN length(body) >= 400 THEN 1 ELSE 2 END AS rank FROM items WHERE enriched_at IS NULL ORDER BY rank, published_at DESC, id LIMIT 200", "items")
add("body_queue", "id long, tier string, rank int", lambda v: digest.body_queue(v.plain), "SELECT id, tier, CASE tier WHEN 'p1' THEN 0 WHEN 'featured' THEN 1 WHEN 'all' THEN 2 ELSE 3 END AS rank FROM items WHERE body_md IS NULL AND url NOT LIKE '%youtube.com/%' AND url NOT LIKE '%//x.com/%' ORDER BY rank, published_at DESC, id LIMIT 100", "items")
RANK = "CASE grp " + " ".join(f"WHEN '{g}' THEN {i + 1}" for i, g in enumerate(fx.GROUPS)) + " END"
add("active_sources", "id string, grp string, name_en string, rank int", lambda v: digest.active_sources(v.sources, fx.GROUPS), f"SELECT id, grp, name_en, {RANK} AS rank FROM sources WHERE enabled", "sources")

# -- texts and URLs ---------------------------------------------------------------------------------------------------

_U = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$'"
CANONICAL = f"""SELECT id, CASE WHEN regexp_matches(t, {_U}) THEN lower(regexp_extract(t, {_U}, 1)) || '://' || lower(regexp_extract(t, {_U}, 2))
    || CASE WHEN p = '' AND q <> '' THEN '/' WHEN p = '/' AND q = '' THEN '' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE t END AS canonical
    FROM (SELECT id, trim(url) AS t, regexp_extract(trim(url), {_U}, 3) AS p,
          array_to_string(list_filter(string_split(substr(regexp_extract(trim(url), {_U}, 4), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{text.TRACKING_PATTERN}')), '&') AS q FROM raw)"""
add("canonical_url", "id long, canonical string", lambda v: v.raw.select("id", text.canonical_url("url").alias("canonical")), CANONICAL, "raw")
_HASH = "sha256(c.canonical || chr(10) || chr(10) || 'page ' || r.id || chr(10) || chr(10) || r.payload)"


def hashed(v: Views) -> DataFrame:
    title = F.concat(text.canonical_url("url"), F.lit("\n\npage "), F.col("id"))
    return v.raw.select("id", text.content_hash(title, F.col("payload")).alias("hash"))


add("content_hash", "id long, hash string", hashed, f"SELECT r.id, {_HASH} AS hash FROM raw r JOIN ({CANONICAL}) c ON r.id = c.id", "raw")
add(
    "raw_dedup",
    "canonical string, first_id long, n long",
    lambda v: v.raw.groupBy(text.canonical_url("url").alias("canonical")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")),
    f"SELECT canonical, min(id) AS first_id, count(*) AS n FROM ({CANONICAL}) GROUP BY canonical",
    "raw",
)
_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_PLAIN = _TRIM("coalesce(payload, '')")
_BARE = f"regexp_replace({_PLAIN}, '<[^>]+>', '', 'g')"
add(
    "strip_html",
    "id long, n long, digest string",
    lambda v: v.raw.select("id", text.strip_html("payload").alias("t")).select("id", F.length("t").alias("n"), F.md5("t").alias("digest")),
    f"SELECT id, length(t) AS n, md5(t) AS digest FROM (SELECT id, CASE WHEN regexp_matches({_PLAIN}, '<[a-zA-Z!/]') THEN {_TRIM(_BARE)} ELSE {_PLAIN} END AS t FROM raw)",
    "raw",
)
add(
    "first_line_title",
    "id long, title string",
    lambda v: v.table("documents").select(F.col("doc_id").alias("id"), text.first_line_title("text").alias("title")),
    """SELECT doc_id AS id, CASE WHEN length(l) <= 120 THEN l ELSE (CASE WHEN position(' ' IN c) > 0 AND length(c) - position(' ' IN reverse(c)) > 60 THEN left(c, length(c) - position(' ' IN reverse(c))) ELSE c END) || '…' END AS title
       FROM (SELECT doc_id, l, left(l, 120) AS c FROM (SELECT doc_id, trim(rtrim(split_part(text, chr(10), 1), chr(13))) AS l FROM documents))""",
)
PRICES = "VALUES ('m0', 2.5, 10.0, 1.25), ('m1', 3.0, 15.0, NULL), ('m2', 0.5, 2.0, 0.1)"
add(
    "cost_compute",
    "id long, computed_usd double",
    lambda v: text.model_cost(v.usage, v.spark.sql(f"SELECT model, CAST(rate_in AS DECIMAL(8, 4)) rate_in, CAST(rate_out AS DECIMAL(8, 4)) rate_out, CAST(rate_cached AS DECIMAL(8, 4)) rate_cached FROM {PRICES} AS p(model, rate_in, rate_out, rate_cached)")),
    f"""SELECT id, round(CAST((input_tokens - cached_input_tokens) * CAST(rate_in AS DECIMAL(8, 4)) + cached_input_tokens * CAST(coalesce(rate_cached, rate_in) AS DECIMAL(8, 4)) + (output_tokens + reasoning_tokens) * CAST(rate_out AS DECIMAL(8, 4)) AS DECIMAL(20, 4)) * 0.000001, 6) AS computed_usd
        FROM usage u LEFT JOIN ({PRICES}) p(p_model, rate_in, rate_out, rate_cached) ON u.model = p.p_model""",
    "usage",
)
LADDER = "VALUES ('m0', false, 1), ('m1', false, 2), ('m1-', false, 3), ('m0', true, 4), ('m2', true, 5)"
_NAMED = "concat(CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'azure/' ELSE 'openai/' END, model, CASE id % 4 WHEN 0 THEN '-standard' ELSE '' END)"
add(
    "pricing_ladder",
    "model string, price_key string, level int",
    lambda v: pricing.resolve(v.usage.select(F.expr(_NAMED).alias("model")), v.spark.sql(f"SELECT * FROM {LADDER} AS p(price_key, fallback, place)")),
    f"""SELECT m.model, price_key, level FROM (SELECT DISTINCT {_NAMED} AS model FROM usage) m LEFT JOIN
        (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY level, place) AS r FROM
          (SELECT n.model, price_key, place, CASE WHEN NOT fallback AND price_key = n.model THEN 1 WHEN NOT fallback AND price_key = bare THEN 2
             WHEN NOT fallback AND starts_with(bare, price_key) AND (contains(price_key, '-') OR length(price_key) >= 6) THEN 3
             WHEN fallback AND price_key IN (bare, n.model) THEN 4 WHEN fallback AND starts_with(bare, price_key) THEN 5 END AS level
           FROM (SELECT DISTINCT {_NAMED} AS model, regexp_replace({_NAMED}, '^(azure/|openai/)', '') AS bare FROM usage) n, ({LADDER}) p(price_key, fallback, place))
          WHERE level IS NOT NULL) WHERE r = 1) f ON m.model = f.model""",
    "usage",
)
_X = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"
add(
    "rss_items",
    "id long, xml string",
    lambda v: v.items.select("id", "published_at", F.col("title").alias("t"), F.concat(F.lit("https://example.org/?a=1&id="), F.col("id")).alias("u"), F.col("id").cast("string").alias("g")).select("id", archive.rss_item("t", "u", "t", "published_at", "g").alias("xml")),
    f"""SELECT id, '<item><title>' || coalesce({_X("title")}, '') || '</title><link>' || {_X("'https://example.org/?a=1&id=' || id")} || '</link><description>' || coalesce({_X("title")}, '')
        || '</description><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><guid isPermaLink="false">' || id || '</guid></item>' AS xml FROM items""",
    "items",
)
# -- streams, and walks that depend on order --------------------------------------------------------------------------

_HOUR = "date_format(hour, 'yyyy-MM-dd HH:mm')"
add(
    "stream_hourly",
    "hour string, event_type string, n long, cents long",
    lambda v: jobs.upserted(jobs.hourly(jobs.events(v.spark, v.sf_dir)), ("hour", "event_type")).withColumn("hour", F.expr(_HOUR)),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL",
)
add(
    "stream_first_seen",
    "user_id long, event_type string",
    lambda v: jobs.drain(jobs.first_seen(jobs.events(v.spark, v.sf_dir)), "append"),
    "SELECT DISTINCT user_id, event_type FROM events",
)
add(
    "stream_sessions",
    "user_id long, began string, n long",
    lambda v: jobs.drain(jobs.sessions(jobs.events(v.spark, v.sf_dir)), "complete").withColumn("began", F.date_format("began", "yyyy-MM-dd HH:mm:ss")),
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM
       (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
         (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
add(
    "snapshot_sample",
    "source string, ts string, digest string",
    lambda v: snapshots.sample(v.table("events").select(F.col("event_type").alias("source"), "ts", F.md5("props").alias("digest"))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
    """SELECT * FROM (WITH RECURSIVE s AS (SELECT event_type AS source, ts, md5(props) AS digest FROM events WHERE ts IS NOT NULL),
       r(source, ts, digest, seen) AS (SELECT source, m.ts, m.digest, [m.digest] FROM (SELECT source, min({'ts': ts, 'digest': digest}) AS m FROM s GROUP BY source)
         UNION ALL SELECT source, m.ts, m.digest, list_append(seen, m.digest) FROM (SELECT r.source, any_value(r.seen) AS seen, min({'ts': s.ts, 'digest': s.digest}) AS m
           FROM r JOIN s ON r.source = s.source AND s.ts >= r.ts + INTERVAL 84 HOURS AND NOT coalesce(list_contains(r.seen, s.digest), false) GROUP BY r.source))
       SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, digest FROM r)""",
)

from tidewire.plans import intake, upkeep  # noqa: E402  they add to the same registry

__all__ = ["QUERIES", "SQL", "intake", "upkeep"]
