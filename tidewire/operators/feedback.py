"""Votes, saved items and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .feed import flat_tags


def fold_toggles(events: DataFrame) -> DataFrame:
    """The votes that stand after a history of (id, item_id, user_id, vote, on), by id.

    Switching a vote on drops the opposite one of up and down; switching on what is on changes nothing. So a vote stands
    if its last event is "on" and no later "on" of the opposite came. Saves stand by themselves."""
    return standing(events.groupBy("item_id", "user_id", "vote").agg(F.max(F.struct("id", "on")).alias("last"), F.max(F.when(F.col("on"), F.col("id"))).alias("on_id")))


def standing(last: DataFrame) -> DataFrame:
    """The votes that stand, from the last event and the last "on" of each (item_id, user_id, vote)."""
    other = F.max(F.when(F.col("vote") != "save", F.struct("on_id", "vote"))).over(Window.partitionBy("item_id", "user_id"))
    # of up and down, the one that was switched on later drops the other
    rows = last.withColumn("latest", other)
    stands = F.col("last.on") & ((F.col("vote") == "save") | (F.col("latest.vote") == F.col("vote")))
    return rows.where(stands).select("item_id", "user_id", "vote", F.col("last.id").alias("id"))


def current_votes(votes: DataFrame) -> DataFrame:
    """up, down, save of each item and user."""
    return votes.groupBy("item_id", "user_id").agg(*[F.max(F.col("vote") == v).alias(v) for v in ("up", "down", "save")])


def collections(votes: DataFrame) -> DataFrame:
    """Each user's collections as the saves name them, with their number of saves; the first is pinned."""
    n = votes.where("vote = 'save' AND collection_id IS NOT NULL").groupBy("user_id", "collection_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("user_id").orderBy(F.desc("pinned"), "sort_order", F.desc("collection_id"))
    return n.withColumn("pinned", F.col("collection_id") == 1).withColumn("sort_order", F.lit(1000)).withColumn("place", F.row_number().over(order))


def saved(votes: DataFrame, items: DataFrame, sources: DataFrame, clusters: DataFrame, limit: int = 50) -> DataFrame:
    """Saved items with source and event, latest first."""
    rows = votes.where("vote = 'save'").select(F.col("id").alias("feedback_id"), "item_id", "user_id", F.col("created_at").alias("saved_at"))
    rows = rows.join(items, rows.item_id == items.id).join(F.broadcast(sources.select(F.col("id").alias("source_id"), "name_en")), "source_id")
    rows = rows.join(clusters.select(F.col("id").alias("cluster_id"), "canonical_title_en"), "cluster_id", "left")
    top = rows.orderBy(F.desc("saved_at"), F.desc("feedback_id")).limit(limit)
    return top.select("feedback_id", "item_id", "user_id", F.coalesce("canonical_title_en", "title_en", "title").alias("title"), "name_en", F.array_join(flat_tags("capabilities", "entities", "topics", 6), ",").alias("tags"))


def rename_collection(name: str) -> str:
    """A valid collection name: trimmed, 1 to 64 characters."""
    name = name.strip()
    if not 1 <= len(name) <= 64:
        raise ValueError("a name has 1 to 64 characters")
    return name


def drop_collection(votes: DataFrame, collection_id: int) -> DataFrame:
    """Votes after a collection is gone: its saves go to the inbox."""
    return votes.withColumn("collection_id", F.when(F.col("collection_id") != collection_id, F.col("collection_id")))


def recent_votes(votes: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    rows = votes.where("vote IN ('up', 'down')").withColumnRenamed("id", "feedback_id").withColumnRenamed("created_at", "voted_at")
    rows = rows.join(items.select(F.col("id").alias("item_id"), "title"), "item_id")
    return rows.orderBy(F.desc("voted_at"), F.desc("feedback_id")).limit(limit).select("feedback_id", "item_id", "vote", "title")
