"""From items to events: assignment, verdicts, merging, leads and roll-ups.

The reference walks items one at a time, so that an item's event depends on the order. Here a step looks at all items at
once: links within the distance are found by a band join, and groups of linked items are the connected components. Where
one pass over pending items is asked for, each is compared with what was there before the pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.shared import cut

from .scoring import authority, event_importance, tier_of
from .vectors import Block, by_block_pairs, nearest, neighbours, timed

JOIN_DISTANCE, WINDOW_HOURS = 0.25, 72
MERGE_MIN, MERGE_MEAN, MERGE_SHARE = 0.25, 0.20, 0.5

#: Titles of events whose items have no content.
NO_CONTENT_ZH = ("未披露", "无法核实", "无法验证", "未提供", "内容不明", "链接占位", "神秘链接")
NO_CONTENT_EN = ("undisclosed", "unable to verify", "cannot be verified", "no verifiable", "without disclosed", "mysterious link")


def assign(items: DataFrame, distance: float = JOIN_DISTANCE, hours: int = WINDOW_HOURS, most: int | None = None) -> DataFrame:
    """What becomes of each pending item (embedded, enriched, in no event): joins the event of its nearest clustered
    neighbour, else forms one with its nearest pending neighbour, else stands alone. id, action, target, distance.

    With `most`, of the pending items with the least ids only."""
    have = items.where("embedding IS NOT NULL")
    pending = have.where("cluster_id IS NULL AND enriched_at IS NOT NULL").select("id")
    if most is not None:
        pending = pending.orderBy("id").limit(most)
    asked = pending.select(F.col("id").alias("p_id"))
    rows = have.join(asked, F.col("id") == F.col("p_id"), "left").select("id", timed(have), "embedding", F.col("p_id").isNotNull().alias("asks"), F.col("cluster_id").isNotNull().cast("int").alias("kind"))
    near = nearest(rows, hours, 1, most=distance)
    best = near.groupBy("id").agg(F.min(F.when(F.col("kind") == 1, F.struct("distance", "o_id"))).alias("c"), F.min(F.when(F.col("kind") == 0, F.struct("distance", "o_id"))).alias("u"))
    events = have.where("cluster_id IS NOT NULL").select(F.col("id").alias("o_id"), F.col("cluster_id").alias("o_cluster_id"))
    found = pending.join(best, "id", "left").join(events, F.col("c.o_id") == F.col("o_id"), "left")
    return found.select(
        "id",
        F.when(F.col("c").isNotNull(), "join").when(F.col("u").isNotNull(), "new").otherwise("single").alias("action"),
        F.when(F.col("c").isNotNull(), F.col("o_cluster_id")).otherwise(F.col("u.o_id")).alias("target"),
        F.coalesce("c.distance", "u.distance").alias("distance"),
    )


def arbitration_candidates(clusters: DataFrame, items: DataFrame, limit: int = 15) -> DataFrame:
    """Events of two or more members that are unverified, or have an unverified member; the largest, then latest, first."""
    open_members = items.where("cluster_verified_at IS NULL AND cluster_id IS NOT NULL").select(F.col("cluster_id").alias("open_id")).distinct()
    rows = clusters.where("member_count >= 2").join(open_members, F.col("id") == F.col("open_id"), "left")
    return rows.where("verified_at IS NULL OR open_id IS NOT NULL").orderBy(F.desc("member_count"), F.desc("updated_at"), F.asc("id")).limit(limit).select("id", "member_count", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def apply_splits(items: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after the verdicts (cluster_id, rejected ids), and the audit rows.

    Only members can be rejected; a verdict that rejects nobody or everybody keeps the event."""
    asked = verdicts.select("cluster_id", F.explode("rejected").alias("id"), "reason").dropDuplicates(["cluster_id", "id"])
    valid = asked.join(items.select("id", "cluster_id"), ["id", "cluster_id"])
    size = items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n"))
    number = valid.groupBy("cluster_id").agg(F.count("*").alias("r")).join(size, "cluster_id").where("r < n").select("cluster_id")
    split = valid.join(number, "cluster_id").select(F.col("id").alias("gone_id"), F.col("cluster_id").alias("from_cluster_id"), "reason")
    after = items.join(split.select("gone_id"), F.col("id") == F.col("gone_id"), "left")
    after = after.withColumn("cluster_id", F.when(F.col("gone_id").isNull(), F.col("cluster_id"))).drop("gone_id")
    return after, split.select(F.col("gone_id").alias("item_id"), "from_cluster_id", "reason")


def has_no_content() -> Column:
    """Three-valued as in SQL: null when a title is null and the other doesn't match."""
    tests = [F.col("canonical_title_zh").ilike(f"%{p}%") for p in NO_CONTENT_ZH] + [F.col("canonical_title_en").ilike(f"%{p}%") for p in NO_CONTENT_EN]
    return reduce(lambda a, b: a | b, tests)


def merge_candidates(clusters: DataFrame, items: DataFrame, hours: int = WINDOW_HOURS, least: float = MERGE_MIN, mean: float = MERGE_MEAN, share: float = MERGE_SHARE, since: str | None = None) -> DataFrame:
    """Pairs of events that are one, by the distances of their members within `hours`. Only titled events take part."""
    multi = clusters.where("member_count >= 2").where(~has_no_content())
    if since:
        multi = multi.where(F.col("latest_member_at") > F.lit(since).cast("timestamp_ntz"))
    member = items.where("embedding IS NOT NULL AND cluster_id IS NOT NULL").join(multi.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")

    def compare(a: Block, b: Block | None, d: np.ndarray, near: np.ndarray) -> Iterator[dict]:
        other = a if b is None else b
        use = near & (a["cluster_id"][:, None] != other["cluster_id"][None, :])
        if b is None:
            use = np.triu(use, 1)
        r, c = np.nonzero(use)
        if not len(r):
            return
        ends = np.sort(np.stack([a["cluster_id"][r], other["cluster_id"][c]], axis=1), axis=1)
        order = np.lexsort((ends[:, 1], ends[:, 0]))
        ends, own = ends[order], d[r, c][order]
        start = np.flatnonzero(np.concatenate([[True], (ends[1:] != ends[:-1]).any(axis=1)]))
        yield {
            "cluster_a": ends[start, 0], "cluster_b": ends[start, 1], "lowest": np.minimum.reduceat(own, start), "total": np.add.reduceat(own, start),
            "within": np.add.reduceat((own <= least).astype(np.int64), start), "n": np.diff(np.append(start, len(own))),
        }

    local = by_block_pairs(member.select("id", timed(member), "embedding", "cluster_id"), hours, compare, "cluster_a long, cluster_b long, lowest double, total double, within long, n long")
    stats = local.groupBy("cluster_a", "cluster_b").agg(F.min("lowest").alias("min_distance"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean_distance"), F.sum("within").alias("pairs_within"), F.sum("n").alias("total_pairs"))
    stats = stats.where((F.col("min_distance") <= least) & (F.col("mean_distance") <= mean) & (F.col("pairs_within") / F.col("total_pairs") >= share))
    size = lambda x: multi.select(F.col("id").alias(f"cluster_{x}"), F.col("member_count").alias(f"size_{x}"))
    return stats.join(size("a"), "cluster_a").join(size("b"), "cluster_b")


def survivors(pairs: DataFrame) -> DataFrame:
    """(cluster_id, survivor): transitive merging of pairs (cluster_a, cluster_b), the least id survives.

    Least labels go over the edges and then jump to their own labels' labels, until nothing changes; labels only fall, so there is an
    end. Lineage is cut each round, in the shared folder."""
    edges = pairs.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b"))
    edges = cut(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l"))
    known = None
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = labels.join(near, "a").select("a", F.least("l", "m").alias("l"))
        jump = step.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        labels = cut(step.join(jump, "l").select("a", F.least("l", "ll").alias("l")))
        total = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if total == known:
            break
        known = total
    return labels.select(F.col("a").alias("cluster_id"), F.col("l").alias("survivor"))


def apply_merges(items: DataFrame, merged: DataFrame) -> DataFrame:
    """Items, with the events that were merged away replaced by their survivors."""
    to = merged.where("cluster_id <> survivor").select(F.col("cluster_id").alias("old"), "survivor")
    return items.join(to, F.col("cluster_id") == F.col("old"), "left").withColumn("cluster_id", F.coalesce("survivor", "cluster_id")).drop("old", "survivor")


def event_scores(items: DataFrame) -> DataFrame:
    """Importance, tier and the union of the three axes of each event."""
    agg = items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(event_importance("importance").alias("importance"), *[F.expr(f"bool_or(coalesce(hkr_{x}, false))").alias(f"hkr_{x}") for x in "hkr"], F.count("*").alias("members"))
    return agg.withColumn("event_tier", F.expr(tier_of("importance")))


def leads(items: DataFrame, sources: DataFrame) -> DataFrame:
    """The lead of each event: highest authority, then earliest, then least id; others are corroborating."""
    src = sources.select(F.col("id").alias("s_id"), "grp", "priority")
    rows = items.where("cluster_id IS NOT NULL").join(F.broadcast(src), F.col("source_id") == F.col("s_id")).withColumn("score", authority("grp", "priority", "importance"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "published_at", "id"))
    return rows.withColumn("place", place).where("place = 1").select("cluster_id", F.col("id").alias("lead_item_id"), (F.col("score") / 10).alias("score"))


def richest(items: DataFrame, most: int = 8000) -> DataFrame:
    """The member with the longest body of each event, least id on ties, and the body cut to `most` characters."""
    rows = items.where("cluster_id IS NOT NULL").withColumn("n", F.coalesce(F.length("body_md"), F.lit(0)))
    best = rows.groupBy("cluster_id").agg(F.min_by(F.struct("id", "body_md"), F.struct(-F.col("n"), F.col("id"))).alias("r"))
    return best.select("cluster_id", F.col("r.id").alias("item_id"), F.md5(F.left(F.coalesce("r.body_md", F.lit("")), F.lit(most))).alias("body_md5"))


def rollup(items: DataFrame) -> DataFrame:
    return items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.date_format(F.min("published_at"), "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"), F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("latest_member_at"))


def members(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Members of the events of two or more, numbered by importance (nulls last), then time, then id."""
    multi = items.where("cluster_id IS NOT NULL").groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").select("cluster_id")
    rows = items.join(multi, "cluster_id", "left_semi").join(F.broadcast(sources.select(F.col("id").alias("source_id"), "name_en")), "source_id")
    order = [F.desc_nulls_last("importance"), F.asc("published_at"), F.asc("id")]
    return rows.select("cluster_id", "id", "name_en", "importance", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order)).alias("place"))


def title_candidates(clusters: DataFrame, limit: int = 15) -> DataFrame:
    stale = "canonical_title_zh IS NULL OR titled_at IS NULL OR updated_at > titled_at"
    return clusters.where("member_count >= 2").where(stale).orderBy(F.desc("member_count"), F.desc("updated_at"), F.asc("id")).limit(limit).select("id", "member_count")


def commentary_candidates(clusters: DataFrame, limit: int = 8) -> DataFrame:
    rows = clusters.where("event_tier IN ('featured', 'p1') AND member_count >= 2 AND commentary_at IS NULL")
    return rows.orderBy(F.desc_nulls_last("importance"), F.desc("updated_at"), F.asc("id")).limit(limit).select("id", "importance", "event_tier")


def commentary_backlog(items: DataFrame, clusters: DataFrame, limit: int = 200) -> DataFrame:
    """Items that wait for their own commentary: in no event of two or more; tier, then recency."""
    rows = items.join(clusters.select(F.col("id").alias("c_id"), "member_count"), F.col("cluster_id") == F.col("c_id"), "left")
    rows = rows.where("commentary_at IS NULL AND enriched_at IS NOT NULL AND tier IN ('featured', 'p1') AND (cluster_id IS NULL OR coalesce(member_count, 1) < 2)")
    rank = F.when(F.col("tier") == "p1", 0).otherwise(1)
    return rows.withColumn("rank", rank).orderBy("rank", F.desc("published_at"), F.asc("id")).limit(limit).select("id", "tier", "rank")


def new_merges(items: DataFrame, distance: float, hours: int = WINDOW_HOURS, k: int = 3) -> DataFrame:
    """Pairs among each item's `k` nearest that are close enough and in different events; the k are taken before a < b."""
    near = neighbours(items, hours, k).where((F.col("distance") <= distance) & (F.col("id") < F.col("o_id")))
    return near.where(~F.col("cluster_id").eqNullSafe(F.col("o_cluster_id"))).select("id", F.col("o_id").alias("other_id"), "distance", (F.col("source_id") != F.col("o_source_id")).alias("cross_source"))


def histogram(pairs: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """Pairs by half-open ranges of distance, and how many cross sources."""
    bucket = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        bucket = F.when((F.col("distance") >= edges[i]) & (F.col("distance") < edges[i + 1]), i).otherwise(bucket)
    return pairs.withColumn("bucket", bucket).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("cross_source").alias("n_cross"))


def sample_pairs(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs at random, without replacement, the same for a seed: those with the least hashes."""
    key = F.md5(F.concat_ws(":", F.lit(seed), "id", "other_id"))
    return pairs.orderBy(key, "id", "other_id").limit(n)


def orchestrate(stages: list[tuple[str, object]]) -> list[tuple[str, object, str | None]]:
    """Run the stages in order; a failing one doesn't stop the next. (name, result, error) of each."""
    out = []
    for name, stage in stages:
        try:
            out.append((name, stage(), None))
        except Exception as e:  # noqa: BLE001  each stage stands alone
            out.append((name, None, f"{type(e).__name__}: {e}"))
    return out
