"""Keeping events right: claims, verdicts, merges, editorial copies, roll-ups, moves of single items, replays.

Each step takes whole tables and gives whole tables: what a row-by-row run would update in place becomes one join of the table
with the changes. Counts are taken from the members, so that no counter can drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.sources.shared import cut

from .cluster import JOIN_DISTANCE, WINDOW_HOURS, leads, survivors
from .scoring import event_importance, tier_of
from .vectors import neighbours

#: Titles that tell where a story was talked about instead of what it is.
BAD_TITLE_ZH = r"(?i)(在\s*Reddit|Reddit\s*上|Reddit\s*流传|Twitter\s*流传|HN\s*讨论|Hacker News\s*讨论|Product Hunt\s*流传|X 平台流传)"
BAD_TITLE_EN = r"(?i)(on Reddit|reddit thread|reddit post|twitter post|on X|HN thread|hacker news thread|spreading on)"


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def claimed(items: DataFrame, clusters: DataFrame, assigned: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Items and events after assign(): joined ones take their event's id, new ones that of the lesser of the two, single ones their own.

    An item claimed by both of a pair is in one event: events are the connected pairs. Events get their counts from their members, and
    `now` as latest_member_at where a member came; events that have no member any more are gone."""
    pairs = assigned.where("action = 'new'").select(F.col("id").alias("cluster_a"), F.col("target").alias("cluster_b"))
    own = survivors(pairs).select(F.col("cluster_id").alias("p_id"), F.col("survivor").alias("p_to"))
    joins = assigned.where("action = 'join'").select(F.col("id").alias("j_id"), F.col("target").alias("j_to"))
    # whoever is linked to a new pair goes with it; a member that joins an event takes only itself there
    alone = assigned.where("action = 'single'").select(F.col("id").alias("a_id"))
    rows = items.join(joins, F.col("id") == F.col("j_id"), "left").join(own, F.col("id") == F.col("p_id"), "left").join(alone, F.col("id") == F.col("a_id"), "left")
    rows = rows.withColumn("came", F.col("cluster_id").isNull() & F.coalesce("j_id", "p_id", "a_id").isNotNull())
    after = rows.withColumn("cluster_id", F.coalesce("cluster_id", "j_to", "p_to", "a_id")).drop("j_id", "j_to", "p_id", "p_to", "a_id")
    n = after.where("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("n_id")).agg(
        F.count("*").alias("n"), F.bool_or("came").alias("new"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.min("id").alias("lead")
    )
    both = clusters.join(n, F.col("id") == F.col("n_id"), "right")  # events without members are left behind
    events = both.select(
        F.col("n_id").alias("id"), F.coalesce("lead_item_id", "lead").alias("lead_item_id"), F.col("n").alias("member_count"), F.col("n").alias("coverage"),
        F.coalesce("first_seen_at", "first").alias("first_seen_at"), F.when(F.col("new"), _at(now)).otherwise(F.coalesce("latest_member_at", "last")).alias("latest_member_at"),
    )
    return after.drop("came"), events


def verdicts_applied(items: DataFrame, clusters: DataFrame, verdicts: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, events and the audit rows after verdicts (cluster_id, verdict keep or split, rejected ids, reason), one an event.

    A split that rejects nobody, or as many as there are, keeps the event. Only members can be rejected. Kept and remaining members are
    verified; so is the event, which counts its members anew and takes importance and tier from those that weren't rejected."""
    size = items.where("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("v_id")).agg(F.count("*").alias("v_n"))
    v = verdicts.select(F.col("cluster_id").alias("v_id"), "verdict", "rejected", "reason").join(size, "v_id")
    out = F.coalesce(F.size("rejected"), F.lit(0))
    v = v.withColumn("gone", F.when((F.col("verdict") == "split") & (out > 0) & (out < F.col("v_n")), F.col("rejected")).otherwise(F.array().cast("array<long>")))
    rows = items.join(v.select("v_id", "gone", "reason"), F.col("cluster_id") == F.col("v_id"), "left")
    out_now = F.coalesce(F.array_contains("gone", F.col("id")), F.lit(False))
    marked = rows.withColumn("_out", out_now)
    audit = marked.where("_out").select(F.col("id").alias("item_id"), F.col("cluster_id").alias("from_cluster_id"), "reason")
    stamp = F.when(F.col("_out"), None).when(F.col("v_id").isNotNull(), F.coalesce("cluster_verified_at", _at(now))).otherwise(F.col("cluster_verified_at"))
    after = marked.withColumn("cluster_verified_at", stamp).withColumn("cluster_id", F.when(~F.col("_out"), F.col("cluster_id"))).drop("_out", "v_id", "gone", "reason")
    left = marked.where("v_id IS NOT NULL AND NOT _out").groupBy(F.col("v_id").alias("l_id")).agg(F.count("*").alias("l_n"), event_importance("importance").alias("l_imp"))
    both = clusters.join(left, F.col("id") == F.col("l_id"), "left")
    judged = F.col("l_id").isNotNull()
    events = both.withColumn("member_count", F.coalesce("l_n", "member_count")).withColumn("verified_at", F.when(judged, _at(now)).otherwise(F.col("verified_at")))
    events = events.withColumn("importance", F.when(judged, F.col("l_imp")).otherwise(F.col("importance"))).withColumn("event_tier", F.when(judged, F.expr(tier_of("l_imp"))).otherwise(F.col("event_tier")))
    return after, events.withColumn("updated_at", F.when(judged, _at(now)).otherwise(F.col("updated_at"))).drop("l_id", "l_n", "l_imp"), audit


def merged(items: DataFrame, clusters: DataFrame, pairs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Items and events after pairs (cluster_a, cluster_b) are merged: the least id of each chain of pairs stays.

    Its counts grow by the items that moved; it is to be verified, titled and commented again. The others are gone."""
    to = survivors(pairs).select(F.col("cluster_id").alias("old"), "survivor")
    moves = to.where("old <> survivor")
    rows = items.join(moves, F.col("cluster_id") == F.col("old"), "left")
    after = rows.withColumn("cluster_verified_at", F.when(F.col("survivor").isNull(), F.col("cluster_verified_at"))).withColumn("cluster_id", F.coalesce("survivor", "cluster_id")).drop("old", "survivor")
    gain = rows.where("survivor IS NOT NULL").groupBy(F.col("survivor").alias("g_id")).agg(F.count("*").alias("g"))
    kept = clusters.join(moves.select(F.col("old").alias("id")), "id", "left_anti").join(gain, F.col("id") == F.col("g_id"), "left")
    grown = F.col("g_id").isNotNull()
    more = F.coalesce("g", F.lit(0))
    events = kept.withColumn("member_count", F.col("member_count") + more).withColumn("coverage", F.col("coverage") + more)
    for c in ("latest_member_at", "updated_at"):
        events = events.withColumn(c, F.when(grown, _at(now)).otherwise(F.col(c)))
    for c in ("verified_at", "titled_at", "commentary_at"):
        events = events.withColumn(c, F.when(~grown, F.col(c)))
    return after, events.drop("g_id", "g")


def tagged_members(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Members of each event: the lead as PRIMARY, the others as CORROBORATING."""
    best = leads(items, sources).select(F.col("cluster_id").alias("b_id"), "lead_item_id")
    rows = items.where("cluster_id IS NOT NULL").join(best, F.col("cluster_id") == F.col("b_id"))
    return rows.select("cluster_id", "id", F.when(F.col("id") == F.col("lead_item_id"), "PRIMARY").otherwise("CORROBORATING").alias("role"))


def leads_checked(clusters: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Events of two or more: their best lead, whether it is another than now, and whether the title must be written again."""
    best = leads(items, sources).select(F.col("cluster_id").alias("id"), F.col("lead_item_id").alias("best"))
    rows = clusters.where("member_count >= 2").join(best, "id")
    bad = F.coalesce(F.col("canonical_title_zh").rlike(BAD_TITLE_ZH), F.lit(False)) | F.coalesce(F.col("canonical_title_en").rlike(BAD_TITLE_EN), F.lit(False))
    changed = F.col("best") != F.col("lead_item_id")
    return rows.select(F.col("id").alias("cluster_id"), F.col("best").alias("lead_item_id"), changed.alias("changed"), (changed | bad).alias("retitle"))


def editorial_filled(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Events without a note take note, importance, tier, axes and commentary date of their lead; coverage follows the count; events of two
    or more have no commentary date, so that their comment is written again."""
    cols = ("editor_note_zh", "editor_note_en", "importance", "hkr_h", "hkr_k", "hkr_r", "commentary_at")
    lead = items.select(F.col("id").alias("i_id"), F.col("tier").alias("i_event_tier"), *[F.col(c).alias(f"i_{c}") for c in cols])
    rows = clusters.join(lead, F.col("lead_item_id") == F.col("i_id"), "left")
    copy = F.col("editor_note_zh").isNull() & F.col("i_id").isNotNull()
    for c in ("editor_note_en", "importance", "hkr_h", "hkr_k", "hkr_r", "commentary_at", "event_tier", "editor_note_zh"):  # the test's own column last
        rows = rows.withColumn(c, F.when(copy, F.col(f"i_{c}")).otherwise(F.col(c)))
    rows = rows.withColumn("commentary_at", F.when(F.col("member_count") < 2, F.col("commentary_at")))
    return rows.withColumn("coverage", F.col("member_count")).select(*clusters.columns)


def rolled_up(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """Events with dates, importance, tier and axes from their members: the latest date only grows, the first stays if known, and axes are
    united only for two or more members."""
    agg = items.where("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("m_id")).agg(
        F.count("*").alias("m_n"), F.min("published_at").alias("m_first"), F.max("published_at").alias("m_last"), event_importance("importance").alias("m_imp"),
        *[F.expr(f"bool_or(coalesce(hkr_{x}, false))").alias(f"m_{x}") for x in "hkr"], F.expr("bool_or(hkr_h IS NOT NULL OR hkr_k IS NOT NULL OR hkr_r IS NOT NULL)").alias("m_any"),
    )
    rows = clusters.join(agg, F.col("id") == F.col("m_id"), "left")
    has, union = F.col("m_id").isNotNull(), (F.col("m_n") >= 2) & F.col("m_any")
    rows = rows.withColumn("latest_member_at", F.greatest("latest_member_at", "m_last")).withColumn("first_seen_at", F.coalesce("first_seen_at", "m_first"))
    rows = rows.withColumn("importance", F.when(has, F.col("m_imp")).otherwise(F.col("importance"))).withColumn("event_tier", F.when(has, F.expr(tier_of("m_imp"))).otherwise(F.col("event_tier")))
    for x in "hkr":
        rows = rows.withColumn(f"hkr_{x}", F.when(union, F.col(f"m_{x}")).otherwise(F.col(f"hkr_{x}")))
    return rows.select(*clusters.columns)


def singles_moved(items: DataFrame, distance: float = JOIN_DISTANCE, hours: int = WINDOW_HOURS) -> DataFrame:
    """(id, old, new): unverified items alone in their event that move to the event of their nearest clustered neighbour.

    The same as one item after the other by date and id, where an item stays once another has moved to it: whether an item moves depends
    only on earlier ones that point to it, so rounds settle all items whose earlier ones are settled, and chains are then followed by
    jumps. Rounds are checkpointed."""
    near = neighbours(items.where("cluster_id IS NOT NULL AND enriched_at IS NOT NULL"), hours, 1).where(F.col("distance") <= distance)
    alone = items.where("cluster_id IS NOT NULL").groupBy(F.col("cluster_id").alias("c")).agg(F.count("*").alias("n")).where("n = 1").select("c")
    free = items.where("cluster_verified_at IS NULL").select(F.col("id").alias("f_id"), F.col("cluster_id").alias("f_c")).join(alone, F.col("f_c") == F.col("c"), "left_semi")
    links = cut(near.join(free, near["id"] == F.col("f_id"), "left_semi").select("id", "o_id", "cluster_id", "o_cluster_id", F.struct("published_at", "id").alias("turn")))
    state = cut(links.select("id", "o_id", "turn", F.lit(None).cast("boolean").alias("moves")))
    while True:
        ahead = state.select(F.col("o_id").alias("id"), F.col("turn").alias("p_turn"), F.col("moves").alias("p_moves"))
        seen = state.join(ahead, "id", "left").where("p_turn IS NULL OR p_turn < turn").groupBy("id").agg(F.bool_or(F.coalesce("p_moves", F.lit(False))).alias("hit"), F.bool_or(F.col("p_turn").isNotNull() & F.col("p_moves").isNull()).alias("wait"))
        step = state.join(seen, "id", "left")
        verdict = F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("wait", F.lit(False)), True)
        state = cut(step.select("id", "o_id", "turn", F.coalesce("moves", verdict).alias("moves")))
        if not state.where("moves IS NULL").limit(1).count():
            break
    went = cut(links.join(state.where("moves").select("id"), "id").select("id", "o_id", F.col("cluster_id").alias("old"), F.col("o_cluster_id").alias("new")))
    while True:  # whoever followed an item that has moved goes where that went
        via = went.select(F.col("id").alias("o_id"), F.col("o_id").alias("n_id"), F.col("new").alias("n_new"))
        if not went.join(via, "o_id", "left_semi").limit(1).count():
            return went.select("id", "old", "new")
        went = cut(went.join(via, "o_id", "left").select("id", F.coalesce("n_id", "o_id").alias("o_id"), "old", F.coalesce("n_new", "new").alias("new")))


def replayed(items: DataFrame, distance: float = JOIN_DISTANCE, hours: int = WINDOW_HOURS) -> DataFrame:
    """(id, cluster_id) of every embedded, enriched item after all events are taken apart and formed anew: items linked to their nearest
    neighbour within the distance are one event, named by its least item; others stand alone."""
    own = items.where("embedding IS NOT NULL AND enriched_at IS NOT NULL")
    near = neighbours(own, hours, 1).where(F.col("distance") <= distance)
    groups = survivors(near.select(F.col("id").alias("cluster_a"), F.col("o_id").alias("cluster_b"))).select(F.col("cluster_id").alias("g"), "survivor")
    return own.join(groups, F.col("id") == F.col("g"), "left").select("id", F.coalesce("survivor", "id").alias("cluster_id"))
