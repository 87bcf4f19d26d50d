"""The derived tables of a data directory: as DataFrames, and as DuckDB SQL for the oracles."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidewire.operators import feed, search
from tidewire.operators.scoring import GROUP_AUTHORITY, TIERS
from tidewire.sources import fixtures as fx


class Views:
    """Tables by name, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def sources(self) -> DataFrame:
        return fx.sources(self.spark, self.sf_dir)

    @cached_property
    def plain(self) -> DataFrame:
        return fx.items(self.spark, self.sf_dir, clustered=False)

    @cached_property
    def items(self) -> DataFrame:
        return fx.items(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return fx.items(self.spark, self.sf_dir, embedded=True)

    @cached_property
    def clusters(self) -> DataFrame:
        return fx.clusters_of(self.items, self.sources)

    @cached_property
    def usage(self) -> DataFrame:
        return fx.llm_usage(self.spark, self.sf_dir)

    @cached_property
    def toggles(self) -> DataFrame:
        return fx.feedback_events(self.spark, self.sf_dir)

    @cached_property
    def votes(self) -> DataFrame:
        return fx.feedback(self.spark, self.sf_dir)

    @cached_property
    def health(self) -> DataFrame:
        return fx.source_health(self.spark, self.sf_dir)

    @cached_property
    def raw(self) -> DataFrame:
        return fx.raw_items(self.spark, self.sf_dir)

    def feed(self, **parts) -> DataFrame:
        return feed.feed(self.items, self.sources, self.clusters, feed.FeedQuery(now=fx.NOW, **parts))

    def found(self, source_id: str | None = None, source_group: str | None = None, source_kind: str | None = None, date_from: str | None = None, date_to: str | None = None, include_excluded: bool = False) -> DataFrame:
        """What a search by vectors looks through: see search.searchable()."""
        return search.searchable(self.vectors, self.sources, self.clusters, source_id, source_group, source_kind, date_from, date_to, include_excluded)

    def table(self, name: str) -> DataFrame:
        return fx.table(self.spark, self.sf_dir, name)


NOW = f"TIMESTAMP '{fx.NOW}'"


def case(values, number: str) -> str:
    return "CASE " + " ".join(f"WHEN {number} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def tier(importance: str) -> str:
    return "CASE " + " ".join(f"WHEN {importance} >= {n} THEN '{t}'" for t, n in TIERS) + " ELSE 'excluded' END"


_AUTHORITY = "(CASE grp " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in GROUP_AUTHORITY.items()) + " ELSE 0 END) * 10 + (2 - priority) * 200 + coalesce(i.importance, 0)"
_PUB = f"({NOW} - to_hours(CAST((doc_id * 37) % 720 AS INT)))"
_IMP = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 31) % 101 AS INT) END"
_TITLE = "left(split_part(text, chr(10), 1), 120)"

#: DuckDB definitions, each of what it needs and of those before it.
SQL = {
    "sources": f"""SELECT source AS id, {case(fx.KINDS, "s")} AS kind, {case(fx.GROUPS, "s")} AS grp, {case(fx.LOCALES, "s")} AS locale, {case(fx.CADENCES, "s")} AS cadence,
        CASE WHEN s % 5 = 0 THEN ['arxiv', 'paper'] ELSE ['news', 't' || (s % 3)] END AS tags, s % 10 <> 9 AS enabled, s % 4 = 0 AS curated, s % 7 = 0 AS never_exclude,
        1 + s % 3 AS priority, 'Source ' || s AS name_en, '源 ' || s AS name_zh FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS s FROM documents WHERE source IS NOT NULL)""",
    "items": f"""SELECT d.doc_id AS id, source AS source_id, {_TITLE} AS title, CASE WHEN d.doc_id % 3 = 0 THEN '标题 ' || d.doc_id END AS title_zh, CASE WHEN d.doc_id % 4 <> 0 THEN {_TITLE} END AS title_en,
        CASE WHEN d.doc_id % 5 <> 0 THEN '摘要 ' || d.doc_id END AS summary_zh, left(text, 200) AS summary_en, text AS body, CASE WHEN d.doc_id % 6 <> 0 THEN text END AS body_md, lang,
        'https://' || source || '.example.com/a/' || d.doc_id AS url, {_PUB.replace("doc_id", "d.doc_id")} AS published_at, {_PUB.replace("doc_id", "d.doc_id")} AS created_at, {_IMP.replace("doc_id", "d.doc_id")} AS importance,
        CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE {_PUB.replace("doc_id", "d.doc_id")} END AS enriched_at, CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE {tier("coalesce(" + _IMP.replace("doc_id", "d.doc_id") + ", 0)")} END AS tier,
        d.doc_id % 2 = 0 AS hkr_h, d.doc_id % 3 = 0 AS hkr_k, coalesce(quality, 0) = 1 AS hkr_r, CASE WHEN d.doc_id % 4 <> 0 THEN ['cap' || (d.doc_id % 4)] ELSE [] END AS capabilities,
        ['ent' || (d.doc_id % 11)] AS entities, ['topic' || (d.doc_id % 5), 'topic' || (d.doc_id % 7)] AS topics, CASE WHEN d.doc_id % 8 <> 0 THEN '注 ' || d.doc_id END AS editor_note_zh,
        CASE WHEN d.doc_id % 9 = 0 THEN 'note ' || d.doc_id END AS editor_note_en, CASE WHEN d.doc_id % 9 = 0 THEN {_PUB.replace("doc_id", "d.doc_id")} END AS commentary_at,
        CASE WHEN d.doc_id % 4 = 0 THEN {_PUB.replace("doc_id", "d.doc_id")} END AS cluster_verified_at, CASE WHEN k.copies > 1 THEN k.first_id WHEN d.doc_id % 2 = 0 THEN d.doc_id END AS cluster_id, CAST(e.embedding AS DOUBLE[]) AS embedding
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id
        LEFT JOIN (SELECT text AS k_text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY text) k ON d.text = k.k_text""",
    "clusters": f"""SELECT id, lead_item_id, member_count, member_count AS coverage, first_seen_at, latest_member_at, CASE WHEN id % 5 <> 0 THEN '事件 ' || id END AS canonical_title_zh, CASE WHEN id % 5 <> 0 THEN 'event ' || id END AS canonical_title_en,
        CASE WHEN member_count > 1 THEN imp END AS importance, CASE WHEN member_count > 1 THEN {tier("imp")} END AS event_tier, CASE WHEN member_count > 1 THEN any_h END AS hkr_h, CASE WHEN member_count > 1 THEN any_k END AS hkr_k, CASE WHEN member_count > 1 THEN any_r END AS hkr_r,
        CASE WHEN id % 3 = 0 THEN '评 ' || id END AS editor_note_zh, CASE WHEN id % 4 = 0 THEN 'comment ' || id END AS editor_note_en, CASE WHEN id % 2 = 1 THEN latest_member_at END AS verified_at, CASE WHEN id % 7 <> 0 THEN latest_member_at END AS titled_at,
        CASE WHEN id % 11 = 0 THEN latest_member_at END AS commentary_at, latest_member_at + to_hours(CAST(id % 48 AS INT)) AS updated_at
        FROM (SELECT cluster_id AS id, first(i.id ORDER BY {_AUTHORITY} DESC, published_at, i.id) AS lead_item_id, count(*) AS member_count, min(published_at) AS first_seen_at, max(published_at) AS latest_member_at,
              least(max(coalesce(i.importance, 0)) + CAST(round(log2(1 + count(*)) * 6) AS INT), 100) AS imp, bool_or(hkr_h) AS any_h, bool_or(hkr_k) AS any_k, bool_or(hkr_r) AS any_r
              FROM items i JOIN sources s ON i.source_id = s.id WHERE cluster_id IS NOT NULL GROUP BY cluster_id)""",
    "j": """SELECT i.*, s.kind AS s_kind, s.grp AS s_grp, s.tags AS s_tags, s.curated AS s_curated, s.name_en AS s_name_en, s.name_zh AS s_name_zh, c.lead_item_id AS c_lead, c.member_count AS c_n, c.first_seen_at AS c_first, c.latest_member_at AS c_last,
        c.canonical_title_zh AS c_tzh, c.canonical_title_en AS c_ten, c.editor_note_zh AS c_nzh, c.editor_note_en AS c_nen, c.hkr_h AS c_h, c.hkr_k AS c_k, c.hkr_r AS c_r, coalesce(c.importance, i.importance) AS eff, coalesce(c.event_tier, i.tier) AS eff_tier
        FROM items i JOIN sources s ON i.source_id = s.id LEFT JOIN clusters c ON i.cluster_id = c.id""",
    "usage": """SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 11 <> 0 THEN event_type END AS task, CASE WHEN user_id % 2 = 0 THEN 'azure-openai' ELSE 'anthropic' END AS provider, 'm' || (user_id % 4) AS model,
        event_id % 4000 AS input_tokens, event_id % 900 AS output_tokens, event_id % 500 AS cached_input_tokens, event_id % 300 AS reasoning_tokens, CASE WHEN event_id % 19 <> 0 THEN CAST(value AS DECIMAL(12, 6)) END AS cost_usd FROM events""",
    "toggles": """SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS item_id, user_id, CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'save' END AS vote,
        CASE WHEN event_id % 3 <> 0 THEN 1 + event_id % 4 END AS collection_id, ts AS created_at, event_id % 4 <> 3 AS switched FROM events WHERE event_type IN ('click', 'error', 'purchase')""",
    "votes": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, user_id, vote ORDER BY id) AS k FROM toggles) WHERE k = 1",
    "health": f"""SELECT id AS source_id, CASE s % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'pending' END AS status, s % 5 AS consecutive_failures, s * 10 AS total_items_count,
        CASE WHEN s % 3 <> 0 THEN {NOW} - to_hours(s) END AS last_success_at FROM (SELECT id, CAST(substr(id, 4) AS INT) AS s FROM sources) WHERE s % 6 <> 5""",
    "raw": "SELECT page_id AS id, url, html AS payload, regexp_extract(url, '://([^/?#]*)', 1) AS source_id FROM pages",
}

_NEEDS = {"clusters": ("sources", "items"), "j": ("sources", "items", "clusters"), "votes": ("toggles",), "health": ("sources",)}


def with_views(body: str, names: tuple[str, ...]) -> str:
    """`body` behind the definitions of the views it names and of those that these need."""
    every = {x for n in names for x in (n, *_NEEDS.get(n, ()))}
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in every) + " " + body if every else body
