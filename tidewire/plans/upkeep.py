"""Registered queries of what keeps events and small state right, and of their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import cluster, feedback, replay, state, upkeep
from tidewire.plans.base import add
from tidewire.plans.views import NOW, Views, tier
from tidewire.sources import fixtures as fx
from tidewire.streaming import jobs

STAMP = "yyyy-MM-dd HH:mm:ss"
_S = "'%Y-%m-%d %H:%M:%S'"

# -- events -----------------------------------------------------------------------------------------------------------


def assigned(v: Views) -> DataFrame:
    """Assignments as a pass could give them: of the items in no event, some join event 0 or 1, some pair up with the next, some stay alone."""
    pending = v.items.where("cluster_id IS NULL")
    return pending.select("id", F.expr("CASE id % 6 WHEN 1 THEN 'join' WHEN 3 THEN 'new' ELSE 'single' END").alias("action"), F.expr("CASE id % 6 WHEN 1 THEN 0 WHEN 3 THEN id - id % 12 + 3 END").alias("target"))


_CLAIM = """WITH a AS (SELECT id, CASE WHEN cluster_id IS NOT NULL THEN cluster_id WHEN id % 6 = 1 THEN 0 WHEN id % 6 = 3 THEN CASE WHEN id % 12 = 3 THEN id ELSE id - id % 12 + 3 END ELSE id END AS cluster_id, cluster_id IS NULL AS came, published_at FROM items)
    SELECT cluster_id AS id, count(*) AS member_count, count(*) AS coverage, bool_or(came) OR max(published_at) = TIMESTAMP '2024-01-31' AS grew FROM a GROUP BY cluster_id"""
add("event_claims", "id long, member_count long, coverage long, grew boolean", lambda v: _claims(v), f"SELECT * FROM ({_CLAIM})", "items")


def _claims(v: Views) -> DataFrame:
    # an item that pairs with one outside the pending is paired with that all the same: targets here are pending or the item itself
    pending = v.items.where("cluster_id IS NULL").select(F.col("id").alias("t_id"))
    asked = assigned(v).join(pending, F.col("target") == F.col("t_id"), "left")
    asked = asked.withColumn("target", F.when(F.col("action") == "new", F.coalesce("t_id", F.col("id") - F.col("id") % 12 + 3)).otherwise(F.col("target"))).drop("t_id")
    _, events = upkeep.claimed(v.items, v.clusters, asked, fx.NOW)
    return events.withColumn("grew", F.col("latest_member_at") == F.lit(fx.NOW).cast("timestamp_ntz"))


def rulings(v: Views) -> DataFrame:
    """Verdicts on events of two or more: kept, split by their greatest member and a stranger, split by nobody, split by all."""
    multi = v.items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("id").alias("m"), F.array_sort(F.collect_list("id")).alias("own")).where("n > 1")
    rejected = F.when(F.col("cluster_id") % 4 == 1, F.array(F.col("m"))).when(F.col("cluster_id") % 4 == 3, F.col("own")).otherwise(F.array().cast("array<long>"))
    return multi.select("cluster_id", F.when(F.col("cluster_id") % 4 == 0, "keep").otherwise("split").alias("verdict"), rejected.alias("rejected"), F.lit("other event").alias("reason"))


_RULED = """WITH m AS (SELECT cluster_id, count(*) AS n, max(id) AS m FROM items WHERE cluster_id IS NOT NULL GROUP BY cluster_id HAVING count(*) > 1),
    r AS (SELECT i.*, m.n, m.cluster_id % 4 = 1 AND i.id = m.m AS gone FROM items i JOIN m ON i.cluster_id = m.cluster_id)"""
add(
    "verdict_events",
    "id long, member_count long, importance int, event_tier string, judged boolean",
    lambda v: upkeep.verdicts_applied(v.items, v.clusters, rulings(v), fx.NOW)[1].withColumn("judged", F.col("updated_at") == F.lit(fx.NOW).cast("timestamp_ntz")),
    f"""SELECT * FROM ({_RULED}, s AS (SELECT cluster_id, count(*) AS k, least(max(coalesce(importance, 0)) + CAST(round(log2(1 + count(*)) * 6) AS INT), 100) AS imp FROM r WHERE NOT gone GROUP BY cluster_id)
        SELECT c.id, coalesce(k, member_count) AS member_count, CASE WHEN k IS NULL THEN importance ELSE imp END AS importance, CASE WHEN k IS NULL THEN event_tier ELSE {tier("imp")} END AS event_tier, k IS NOT NULL OR updated_at = {NOW} AS judged FROM clusters c LEFT JOIN s ON c.id = s.cluster_id)""",
    "clusters",
)
add(
    "verdict_items",
    "id long, cluster_id long, verified boolean",
    lambda v: upkeep.verdicts_applied(v.items, v.clusters, rulings(v), fx.NOW)[0].select("id", "cluster_id", F.col("cluster_verified_at").isNotNull().alias("verified")),
    f"SELECT * FROM ({_RULED} SELECT i.id, CASE WHEN coalesce(gone, false) THEN NULL ELSE i.cluster_id END AS cluster_id, CASE WHEN gone THEN false WHEN gone IS NOT NULL THEN true ELSE i.cluster_verified_at IS NOT NULL END AS verified FROM items i LEFT JOIN r ON i.id = r.id)",
    "items",
)


def pairs(v: Views) -> DataFrame:
    """Events that are one, as chains: every multi-member event with the next greater of its rest class."""
    multi = v.clusters.where("member_count > 1").select("id")
    from pyspark.sql import Window

    after = F.lead("id").over(Window.partitionBy(F.col("id") % 5).orderBy("id"))
    return multi.select(F.col("id").alias("cluster_a"), after.alias("cluster_b")).where("cluster_b IS NOT NULL")


add(
    "merge_apply",
    "id long, member_count long, coverage long, stale boolean",
    lambda v: upkeep.merged(v.items, v.clusters, pairs(v), fx.NOW)[1].select("id", "member_count", "coverage", (F.col("verified_at").isNull() & F.col("titled_at").isNull() & F.col("commentary_at").isNull() & (F.col("updated_at") == F.lit(fx.NOW).cast("timestamp_ntz"))).alias("stale")),
    f"""SELECT min(id) AS id, sum(member_count) AS member_count, sum(member_count) AS coverage, count(*) > 1 OR bool_and(verified_at IS NULL AND titled_at IS NULL AND commentary_at IS NULL AND updated_at = {NOW}) AS stale FROM clusters WHERE member_count > 1 GROUP BY id % 5
        UNION ALL SELECT id, member_count, coverage, verified_at IS NULL AND titled_at IS NULL AND commentary_at IS NULL AND updated_at = {NOW} FROM clusters WHERE member_count = 1""",
    "clusters",
)
add("member_roles", "cluster_id long, id long, role string", lambda v: upkeep.tagged_members(v.items, v.sources), "SELECT cluster_id, id, CASE WHEN id = c_lead THEN 'PRIMARY' ELSE 'CORROBORATING' END AS role FROM j WHERE cluster_id IS NOT NULL", "j")


def mistitled(v: Views) -> DataFrame:
    """Events with their first member for a lead, and titles that tell where a story was talked about."""
    first = v.items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.min("id").alias("first"))
    rows = v.clusters.join(first, F.col("id") == F.col("cluster_id"))
    return rows.withColumn("lead_item_id", F.col("first")).withColumn("canonical_title_en", F.expr("CASE id % 4 WHEN 0 THEN 'A thing spreading ON reddit' WHEN 1 THEN 'Plain' END")).withColumn("canonical_title_zh", F.expr("CASE id % 6 WHEN 2 THEN '某事在 Reddit 流传' WHEN 3 THEN '某事' END"))


add(
    "lead_check",
    "cluster_id long, lead_item_id long, changed boolean, retitle boolean",
    lambda v: upkeep.leads_checked(mistitled(v), v.items, v.sources),
    """SELECT c.id AS cluster_id, lead_item_id, lead_item_id <> f AS changed, lead_item_id <> f OR c.id % 4 = 0 OR c.id % 6 = 2 AS retitle FROM clusters c JOIN (SELECT cluster_id, min(id) AS f FROM items GROUP BY cluster_id) m ON c.id = m.cluster_id WHERE member_count >= 2""",
    "clusters",
)
add(
    "editorial_fill",
    "id long, coverage long, editor_note_zh string, editor_note_en string, importance int, event_tier string, hkr_h boolean, commented boolean",
    lambda v: upkeep.editorial_filled(v.clusters.withColumn("coverage", F.col("coverage") - 1), v.items).withColumn("commented", F.col("commentary_at").isNotNull()),
    """SELECT c.id, member_count AS coverage, CASE WHEN e THEN i.editor_note_zh ELSE c.editor_note_zh END AS editor_note_zh, CASE WHEN e THEN i.editor_note_en ELSE c.editor_note_en END AS editor_note_en, CASE WHEN e THEN i.importance ELSE c.importance END AS importance,
       CASE WHEN e THEN i.tier ELSE c.event_tier END AS event_tier, CASE WHEN e THEN i.hkr_h ELSE c.hkr_h END AS hkr_h, member_count < 2 AND CASE WHEN e THEN i.commentary_at ELSE c.commentary_at END IS NOT NULL AS commented
       FROM (SELECT *, editor_note_zh IS NULL AS e FROM clusters) c JOIN items i ON i.id = c.lead_item_id""",
    "clusters",
)
add(
    "event_rollup",
    "id long, first_seen_at string, latest_member_at string, importance int, event_tier string, hkr_h boolean, hkr_k boolean",
    lambda v: upkeep.rolled_up(_aged(v), v.items).withColumn("first_seen_at", F.date_format("first_seen_at", STAMP)).withColumn("latest_member_at", F.date_format("latest_member_at", STAMP)),
    f"""SELECT c.id, strftime(CASE WHEN c.id % 2 = 0 THEN f ELSE TIMESTAMP '2020-01-01' END, {_S}) AS first_seen_at, strftime(CASE c.id % 3 WHEN 0 THEN l WHEN 1 THEN l ELSE TIMESTAMP '2030-01-01' END, {_S}) AS latest_member_at, imp AS importance, {tier("imp")} AS event_tier,
        CASE WHEN n >= 2 THEN h ELSE c.hkr_h END AS hkr_h, CASE WHEN n >= 2 THEN k ELSE c.hkr_k END AS hkr_k FROM clusters c JOIN (SELECT cluster_id, count(*) AS n, min(published_at) AS f, max(published_at) AS l, least(max(coalesce(importance, 0)) + CAST(round(log2(1 + count(*)) * 6) AS INT), 100) AS imp, bool_or(hkr_h) AS h, bool_or(hkr_k) AS k FROM items GROUP BY cluster_id) m ON c.id = m.cluster_id""",
    "clusters",
)


def _aged(v: Views) -> DataFrame:
    """Events with unknown, old and future dates."""
    date = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = v.clusters.withColumn("first_seen_at", F.when(F.col("id") % 2 == 1, date("2020-01-01")))
    return rows.withColumn("latest_member_at", F.when(F.col("id") % 3 == 1, date("2020-01-01")).when(F.col("id") % 3 == 2, date("2030-01-01")))


_PATTERN = "CASE id % 16 " + " ".join(f"WHEN {k} THEN concat('x ', '{p}', ' y')" for k, p in enumerate((*cluster.NO_CONTENT_ZH, *cluster.NO_CONTENT_EN))) + " ELSE 'plain' END"
add(
    "no_content",
    "id long, skipped boolean",
    lambda v: v.clusters.withColumn("canonical_title_zh", F.expr(f"CASE WHEN id % 16 < {len(cluster.NO_CONTENT_ZH)} THEN {_PATTERN} WHEN id % 5 <> 0 THEN 'z' END")).withColumn("canonical_title_en", F.expr(f"CASE WHEN id % 16 >= {len(cluster.NO_CONTENT_ZH)} THEN upper({_PATTERN}) WHEN id % 7 <> 0 THEN 'e' END")).select("id", cluster.has_no_content().alias("skipped")),
    "SELECT id, CASE WHEN id % 16 < 13 THEN true WHEN id % 5 = 0 THEN NULL ELSE false END AS skipped FROM clusters",
    "clusters",
)
_NEAR1 = """near AS (SELECT a.id, b.id AS o_id, round(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS distance FROM items a JOIN items b
    ON a.id <> b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND a.enriched_at IS NOT NULL AND b.enriched_at IS NOT NULL AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 72 * 3600000000)"""
add(
    "replay_events",
    "id long, cluster_id long",
    lambda v: upkeep.replayed(v.vectors, distance=0.75),
    f"""SELECT * FROM (WITH RECURSIVE {_NEAR1}, one AS (SELECT id, o_id FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, o_id) = 1 AND distance <= 0.75), e AS (SELECT id AS a, o_id AS b FROM one UNION SELECT o_id, id FROM one), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        g AS (SELECT a, min(b) AS m FROM r GROUP BY a) SELECT id, coalesce(m, id) AS cluster_id FROM items LEFT JOIN g ON id = a WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL)""",
    "items",
)
_ALL_NEAR = """near AS (SELECT a.id, b.id AS o_id, a.cluster_id, b.cluster_id AS o_cluster_id, round(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS distance FROM items a JOIN items b
    ON a.id <> b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 72 * 3600000000)"""
# one item a step: ev holds each item's event by its number, 0 for none
_REPLAY = """WITH RECURSIVE own AS (SELECT id, published_at, embedding, row_number() OVER (ORDER BY id) AS n FROM items WHERE embedding IS NOT NULL AND enriched_at IS NOT NULL),
    pairs AS (SELECT a.n, b.n AS o, round(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS distance
      FROM own a JOIN own b ON a.n <> b.n AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 72 * 3600000000),
    close AS MATERIALIZED (SELECT n, list(o ORDER BY distance, o) AS os FROM pairs WHERE distance <= 0.75 GROUP BY n),
    walk(n, ev) AS (SELECT 0::BIGINT, list_transform(range((SELECT count(*) FROM own)), lambda x: 0::BIGINT)
      UNION ALL SELECT n, CASE WHEN ev[n] <> 0 THEN ev WHEN there IS NOT NULL THEN list_concat(list_concat(ev[:n - 1], [ev[there]]), ev[n + 1:])
          ELSE list_transform(ev, lambda e, i: CASE WHEN i = n OR i = free THEN n ELSE e END) END
      FROM (SELECT w.n + 1 AS n, ev, list_filter(coalesce(os, []), lambda o: ev[o] <> 0)[1] AS there, coalesce(list_filter(coalesce(os, []), lambda o: ev[o] = 0)[1], 0) AS free
        FROM walk w LEFT JOIN close c ON c.n = w.n + 1 WHERE w.n < {}))
    SELECT o.id, k.id AS cluster_id FROM (SELECT unnest(ev) AS e, generate_subscripts(ev, 1) AS n FROM walk WHERE n = {}) l JOIN own o ON l.n = o.n JOIN own k ON k.n = l.e"""
_ALL_OWN = "(SELECT count(*) FROM own)"
add("replay_in_order", "id long, cluster_id long", lambda v: replay.in_order(v.vectors, distance=0.75), f"SELECT * FROM ({_REPLAY.format(_ALL_OWN, _ALL_OWN)})", "items")
add("replay_pass", "id long, cluster_id long", lambda v: replay.in_order(v.vectors, distance=0.75, most=200), f"SELECT * FROM ({_REPLAY.format(f'least(200, {_ALL_OWN})', f'least(200, {_ALL_OWN})')})", "items")
add("singles_moved", "id long, old long, new long", lambda v: upkeep.singles_moved(v.vectors, distance=0.75))
add("sampled_pairs", "id long, other_id long", lambda v: cluster.sample_pairs(cluster.new_merges(v.vectors, 0.8), 50, seed=3), f"""SELECT * FROM (WITH {_ALL_NEAR} SELECT id, o_id AS other_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, o_id) AS rank FROM near)
    WHERE rank <= 3 AND id < o_id AND distance <= 0.8 AND cluster_id IS DISTINCT FROM o_cluster_id ORDER BY md5('3:' || id || ':' || o_id), id LIMIT 50)""", "items")

# -- small state ------------------------------------------------------------------------------------------------------

_E = "(SELECT event_id AS id, ts, user_id, props FROM events)"


def commits(v: Views) -> DataFrame:
    return v.table("events").where("event_id % 40 = 0").select(F.col("event_id").alias("id"), F.expr("concat('skill', user_id % 3)").alias("skill"), F.expr("concat('policy ', event_id)").alias("content"), F.col("ts").alias("committed_at"))


def versions(v: Views) -> DataFrame:
    start = v.spark.sql("SELECT 'skill0' AS skill, 7 AS version, 'old' AS content, TIMESTAMP_NTZ '2023-01-01' AS committed_at")
    seeds = v.spark.sql("SELECT * FROM VALUES ('skill0', 's0'), ('skill9', 's9') AS t(skill, content)")
    return state.committed(state.seeded(start, seeds, "2023-06-01"), commits(v))


_VERSIONS = """SELECT skill, v0 + row_number() OVER (PARTITION BY skill ORDER BY ts, id) AS version, content FROM (SELECT event_id AS id, ts, 'skill' || (user_id % 3) AS skill, CASE user_id % 3 WHEN 0 THEN 7 ELSE 0 END AS v0, 'policy ' || event_id AS content FROM events WHERE event_id % 40 = 0)
    UNION ALL SELECT 'skill0', 7, 'old' UNION ALL SELECT 'skill9', 1, 's9'"""
add("policy_versions", "skill string, version int, content string", versions, _VERSIONS)
add("active_policy", "skill string, version int, content string, hash string", lambda v: state.active(versions(v)), f"SELECT skill, max(version) AS version, arg_max(content, version) AS content, left(sha256(arg_max(content, version)), 8) AS hash FROM ({_VERSIONS}) GROUP BY skill")
add("iteration_guard", "votes long, allowed boolean", lambda v: state.may_iterate(v.votes), "SELECT count(*) FILTER (vote <> 'save') AS votes, count(*) FILTER (vote <> 'save') >= 5 AS allowed FROM votes", "votes")


def run_events(v: Views) -> DataFrame:
    """What happened to each run: begun, proposed or failed, applied or rejected; some with steps out of order or twice."""
    e = v.table("events").where("event_id % 40 = 1").select(F.col("event_id").alias("run_id"), F.expr("concat('skill', user_id % 3)").alias("skill"), "ts")
    steps = """filter(array(named_struct('h', 0, 'step', 'running'), CASE WHEN run_id % 5 <> 0 THEN named_struct('h', 1, 'step', 'proposed') END, CASE WHEN run_id % 5 = 0 OR run_id % 7 = 0 THEN named_struct('h', 2, 'step', 'failed') END,
        CASE WHEN run_id % 3 = 0 THEN named_struct('h', 3, 'step', 'applied') END, CASE WHEN run_id % 3 = 1 OR run_id % 6 = 0 THEN named_struct('h', 4, 'step', 'rejected') END), x -> x IS NOT NULL)"""
    return e.withColumn("s", F.explode(F.expr(steps))).select("run_id", "skill", (F.col("ts") + F.make_interval(hours=F.col("s.h"))).alias("at"), F.col("s.step").alias("step"))


_RUNS = """SELECT event_id AS run_id, 'skill' || (user_id % 3) AS skill, ts AS created_at, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 3 = 0 THEN 'applied' WHEN event_id % 3 = 1 THEN 'rejected' ELSE 'proposed' END AS status FROM events WHERE event_id % 40 = 1"""
add("iteration_runs", "run_id long, skill string, status string", lambda v: state.runs(run_events(v)), f"SELECT run_id, skill, status FROM ({_RUNS})")
add("latest_runs", "skill string, run_id long, status string", lambda v: state.latest_run(state.runs(run_events(v))), f"SELECT skill, arg_max(run_id, (created_at, run_id)) AS run_id, arg_max(status, (created_at, run_id)) AS status FROM ({_RUNS}) GROUP BY skill")
add("run_history", "skill string, run_id long, status string, place int", lambda v: state.run_history(state.runs(run_events(v))), f"SELECT * FROM (SELECT skill, run_id, status, row_number() OVER (PARTITION BY skill ORDER BY created_at DESC, run_id DESC) AS place FROM ({_RUNS}) WHERE status <> 'proposed') WHERE place <= 20")


def drafts(v: Views) -> DataFrame:
    return v.table("events").where("event_id % 20 = 2").select(
        F.col("event_id").alias("id"), F.lit("daily").alias("kind"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'zh' ELSE 'en' END").alias("locale"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("period_start"),
        F.expr("CASE WHEN event_id % 3 <> 0 THEN concat('column ', event_id) END").alias("column_title"), F.expr("concat('summary ', event_id)").alias("summary"), F.expr("event_id % 7 = 0").alias("force"),
    )


_DIGESTS = """SELECT locale, period_start, max(id) AS id, arg_max(title, id) AS column_title, count(*) AS writes FROM (SELECT *, row_number() OVER (PARTITION BY locale, period_start ORDER BY id) AS k FROM
    (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'zh' ELSE 'en' END AS locale, date_trunc('day', ts) AS period_start, 'column ' || event_id AS title, event_id % 7 = 0 AS force FROM events WHERE event_id % 20 = 2)) WHERE force OR k = 1 GROUP BY locale, period_start"""
_TITLED = f"SELECT id, strftime(period_start, '%Y-%m-%d') AS day, column_title FROM ({_DIGESTS}) WHERE locale = 'zh' AND id % 3 <> 0"
day = lambda df: df.select("id", F.date_format("period_start", "yyyy-MM-dd").alias("day"), "column_title")
add("digest_upsert", "locale string, day string, id long, writes long", lambda v: state.digests_after(drafts(v)).withColumn("day", F.date_format("period_start", "yyyy-MM-dd")), f"SELECT locale, strftime(period_start, '%Y-%m-%d') AS day, id, writes FROM ({_DIGESTS})")
add("daily_columns", "id long, day string, column_title string", lambda v: day(state.column_list(state.digests_after(drafts(v)), 1, 10)), f"SELECT * FROM ({_TITLED}) ORDER BY day DESC LIMIT 10")
add("daily_column_of", "id long, day string, column_title string", lambda v: day(state.column_of(state.digests_after(drafts(v)), "2024-01-10")), f"SELECT * FROM ({_TITLED}) WHERE day = '2024-01-10'")


def column_feed(v: Views) -> DataFrame:
    """The items of the feed of daily columns: title, link, day, the latest first."""
    rows = state.column_list(state.digests_after(drafts(v)), 1, 50)
    key = F.date_format("period_start", "yyyy-MM-dd")
    return rows.select("id", F.concat(F.lit("Daily · "), key, F.lit(" · "), "column_title").alias("title"), F.concat(F.lit("https://a.example/zh/daily/"), key).alias("link"), F.col("summary").alias("description"))


add("daily_column_rss", "id long, title string, link string, description string", column_feed, f"SELECT id, 'Daily · ' || day || ' · ' || column_title AS title, 'https://a.example/zh/daily/' || day AS link, 'summary ' || id AS description FROM ({_TITLED}) ORDER BY day DESC LIMIT 50")
add(
    "newsletter_rss",
    "id long, html string",
    lambda v: _letters(v),
    """SELECT event_id AS id, '<h3>Digest ' || event_id || '</h3>' || chr(10) || '<p>Body &amp; more</p>' || chr(10) || '<ul><li>one</li>' || chr(10) || '<li>two</li></ul>' AS html FROM events WHERE event_id % 20 = 2 AND event_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 60""",
)


def _letters(v: Views) -> DataFrame:
    from tidewire.functions.content import simple_html

    rows = v.table("events").where("event_id % 20 = 2 AND event_id % 3 = 0").orderBy(F.desc("ts"), F.desc("event_id")).limit(60)
    return rows.select(F.col("event_id").alias("id"), F.expr("concat('## Digest ', event_id, '\\n\\nBody & more\\n\\n- one\\n- two')").alias("md")).select("id", simple_html("md").alias("html"))


def checked(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    return text.phrases(rows, "t", ("the of", " and and "))


add(
    "qc_log",
    "id long, l1_pass boolean, l2_pass boolean, n int, first_layer int",
    lambda v: state.qc_log(checked(v), F.when(F.col("phrase") == "the of", 1).otherwise(2)).select("id", "l1_pass", "l2_pass", F.size("hits").alias("n"), F.col("hits")[0]["layer"].alias("first_layer")),
    "SELECT id, NOT a AS l1_pass, NOT b AS l2_pass, a::INT + b::INT AS n, CASE WHEN a THEN 1 ELSE 2 END AS first_layer FROM (SELECT doc_id AS id, contains(coalesce(text, ''), 'the of') AS a, contains(coalesce(text, ''), ' and and ') AS b FROM documents) WHERE a OR b",
)
add("reset_failed", "n long", lambda v: state.reset(v.plain, "enriched_at", "body_md IS NULL")[1], "SELECT count(*) AS n FROM items WHERE body_md IS NULL AND enriched_at IS NOT NULL", "items")
add("reset_items", "id long, enriched boolean", lambda v: state.reset(v.plain, "enriched_at", "tier IN ('featured', 'p1', 'all')")[0].select("id", F.col("enriched_at").isNotNull().alias("enriched")), "SELECT id, enriched_at IS NOT NULL AND NOT coalesce(tier IN ('featured', 'p1', 'all'), false) AS enriched FROM items", "items")
add("removal_plan", "id string, action string, n long, safe boolean", lambda v: state.removal_plan(v.sources, v.plain.where("source_id <> 'src2'"), ("src1", "src2"), ("src3",)), "SELECT s.id, CASE WHEN s.id = 'src3' THEN 'disable' ELSE 'remove' END AS action, count(i.id) AS n, s.id = 'src3' OR count(i.id) = 0 AS safe FROM sources s LEFT JOIN items i ON i.source_id = s.id AND source_id <> 'src2' WHERE s.id IN ('src1', 'src2', 'src3') GROUP BY s.id", "items", "sources")


def after_removal(v: Views) -> DataFrame:
    plan = state.removal_plan(v.sources, v.plain.where("source_id <> 'src2'"), ("src2",), ("src3",))
    left, health = state.removed(v.sources, v.health, plan)
    return left.join(health.select("source_id", F.lit(True).alias("h")), F.col("id") == F.col("source_id"), "left").select("id", "enabled", F.col("h").isNotNull().alias("has_health"))


add("removal_apply", "id string, enabled boolean, has_health boolean", after_removal, "SELECT s.id, enabled AND s.id <> 'src3' AS enabled, h.source_id IS NOT NULL AS has_health FROM sources s LEFT JOIN health h ON s.id = h.source_id WHERE s.id <> 'src2'", "health")


def collection_ops(v: Views) -> DataFrame:
    """Operations on collections in order of id: created, renamed, pinned, deleted, with blank and clashing names."""
    e = v.table("events").where("event_id % 2 = 0")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.expr("event_id % 4").alias("collection_id"), F.expr("CASE event_id % 5 WHEN 0 THEN 'create' WHEN 4 THEN 'delete' ELSE 'update' END").alias("op"),
        F.expr("CASE event_id % 3 WHEN 0 THEN concat(' name ', event_id % 9, ' ') WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN ' ' END ELSE concat('n', event_id) END").alias("name"), F.expr("CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END").alias("pinned"),
    )


add(
    "collection_state",
    "user_id long, collection_id long, name string, pinned boolean",
    lambda v: state.collections_after(collection_ops(v)),
    """WITH o AS (SELECT event_id AS id, user_id, event_id % 4 AS collection_id, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 4 THEN 'delete' ELSE 'update' END AS op, trim(CASE event_id % 3 WHEN 0 THEN ' name ' || (event_id % 9) || ' ' WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN ' ' END ELSE 'n' || event_id END) AS name, CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END AS pinned FROM events WHERE event_id % 2 = 0),
       k AS (SELECT * FROM o WHERE op = 'delete' OR (name IS NULL AND op = 'update') OR length(name) BETWEEN 1 AND 64), d AS (SELECT user_id, collection_id, max(id) FILTER (op = 'delete') AS ended FROM k GROUP BY ALL),
       l AS (SELECT k.* FROM k JOIN d USING (user_id, collection_id) WHERE op <> 'delete' AND (ended IS NULL OR id > ended)), b AS (SELECT user_id, collection_id, min(id) FILTER (op = 'create') AS began FROM l GROUP BY ALL),
       n AS (SELECT user_id, collection_id, arg_max(name, id) FILTER (name IS NOT NULL) AS name, coalesce(arg_max(pinned, id) FILTER (pinned IS NOT NULL), false) AS pinned, min(id) AS began FROM l JOIN b USING (user_id, collection_id) WHERE id >= began GROUP BY ALL)
       SELECT user_id, collection_id, name, pinned FROM n QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY n.began) = 1""",
)


def moves(v: Views) -> DataFrame:
    return v.votes.where("vote = 'save' AND id % 2 = 0").select("id", "user_id", "item_id", F.expr("CASE WHEN id % 6 <> 0 THEN 9 END").alias("collection_id"))


add("collection_moves", "item_id long, user_id long, vote string, collection_id long", lambda v: state.moved(v.votes, moves(v)), "SELECT item_id, user_id, vote, CASE WHEN vote = 'save' AND id % 2 = 0 THEN CASE WHEN id % 6 <> 0 THEN 9 END ELSE collection_id END AS collection_id FROM votes", "votes")
add("collection_dropped", "item_id long, user_id long, vote string, collection_id long", lambda v: feedback.drop_collection(v.votes, 2), "SELECT item_id, user_id, vote, CASE WHEN collection_id <> 2 THEN collection_id END AS collection_id FROM votes", "votes")
add("tier_floor", "id long, tier string, backfilled string", lambda v: state.floored_tier(v.plain, v.sources).join(state.floored_backfill(v.plain.withColumn("source_id", F.when(F.col("id") % 3 == 0, "some-yt").otherwise("other"))).select("id", F.col("tier").alias("backfilled")), "id"), "SELECT i.id, CASE WHEN tier = 'excluded' AND never_exclude THEN 'all' ELSE tier END AS tier, CASE WHEN tier = 'excluded' AND i.id % 3 = 0 THEN 'all' ELSE tier END AS backfilled FROM items i JOIN sources s ON i.source_id = s.id", "items", "sources")


def scored(v: Views) -> DataFrame:
    bag = "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{\"h\":true}' WHEN 2 THEN '{\"h\":true,\"reasonsZh\":null,\"reasonsEn\":[]}' ELSE '{\"reasonsZh\":[],\"reasonsEn\":[\"a\"]}' END"
    return v.plain.select("id", "enriched_at", F.expr(bag).alias("hkr"), F.expr("CASE WHEN id % 7 <> 0 THEN 'z' END").alias("reasoning_zh"), F.lit("e").alias("reasoning_en"))


add("stale_scores", "id long", lambda v: state.stale_scores(scored(v)), "SELECT id FROM items WHERE enriched_at IS NOT NULL AND (id % 5 < 2 OR id % 7 = 0)", "items")

# -- streams ----------------------------------------------------------------------------------------------------------

add(
    "stream_votes",
    "item_id long, user_id long, vote string, id long",
    lambda v: jobs.voted(v.spark, v.sf_dir, v.table("documents").count()),
    """SELECT item_id, user_id, vote, id FROM (SELECT item_id, user_id, vote, max(id) AS id, first(switched ORDER BY id DESC) AS last_on FROM toggles GROUP BY item_id, user_id, vote) t
       WHERE last_on AND NOT EXISTS (SELECT 1 FROM toggles o WHERE o.item_id = t.item_id AND o.user_id = t.user_id AND o.switched AND o.vote <> 'save' AND t.vote <> 'save' AND o.vote <> t.vote
         AND o.id > (SELECT max(x.id) FROM toggles x WHERE x.item_id = t.item_id AND x.user_id = t.user_id AND x.vote = t.vote AND x.switched))""",
    "toggles",
)
add(
    "stream_health",
    "source_id string, failures long, total long",
    lambda v: jobs.healthy(jobs.fetches(jobs.events(v.spark, v.sf_dir))),
    """SELECT 'u' || (user_id % 50) AS source_id, count(*) FILTER (event_type = 'error' AND event_id > coalesce(ok, -1)) AS failures, count(*) FILTER (event_type <> 'error') AS total FROM
       (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id % 50) AS ok FROM events) GROUP BY user_id % 50""",
)
add(
    "stream_cohorts",
    "id long, cohort string",
    lambda v: jobs.cohorts(jobs.events(v.spark, v.sf_dir)),
    "SELECT event_id AS id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS cohort FROM events WHERE event_type = 'purchase'",
)

_CADENCE_RUNS = """SELECT '{c}' AS cadence, 'u' || (user_id % 50) AS source_id, strftime(date_trunc('{p}', ts), '%Y-%m-%d %H:%M') AS began,
       strftime(date_trunc('{p}', ts) + {l}, '%Y-%m-%d %H:%M') AS due_at, count(*) AS n, max(event_id) AS last_id FROM events WHERE user_id % 3 = {k} AND ts IS NOT NULL GROUP BY ALL"""
add(
    "cadence_runs",
    "cadence string, source_id string, began string, due_at string, n long, last_id long",
    lambda v: jobs.cadence_runs(jobs.fetches(jobs.events(v.spark, v.sf_dir))).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("began", "due_at")}),
    " UNION ALL ".join(_CADENCE_RUNS.format(c=c, p=p, l=l, k=k) for k, (c, (p, l)) in enumerate(jobs.BUCKETS.items())),
)


def _due(v: Views) -> DataFrame:
    """Which cadences are due in each hour that has events."""
    hours = v.table("events").where("ts IS NOT NULL").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    every = hours.withColumn("cadence", F.explode(F.array(*[F.lit(c) for c in fx.CADENCES])))
    return every.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "cadence", jobs.due(F.col("hour") + F.expr("INTERVAL 7 MINUTES")).alias("due"))


add(
    "due_buckets",
    "hour string, cadence string, due boolean",
    _due,
    """SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, cadence, CASE cadence WHEN 'hourly' THEN true WHEN 'daily' THEN hour(h) = 0 ELSE hour(h) = 0 AND isodow(h) = 1 END AS due
       FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE ts IS NOT NULL) CROSS JOIN (VALUES ('hourly'), ('daily'), ('weekly')) t(cadence)""",
)
