"""Structured Streaming forms: each reads what is new, keeps its progress in the shared folder, and ends when it has read all.

A rerun of a job with the same folder goes on where the last one stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import vectors
from tidewire.operators.cluster import JOIN_DISTANCE, WINDOW_HOURS
from tidewire.sources.fixtures import PUBLISHED
from tidewire.sources.shared import shared_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, with event time `at`."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run the stream over all that is there; the result table. Complete mode rewrites it, append adds to it."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upserted(stream: DataFrame, keys: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """Run an aggregation in update mode over all that is there; its table: each key's row of the last batch that changed it.

    A batch writes only the keys that it changed, to a place of its own, which a batch that is run again replaces: nothing that was
    written before is rewritten, and a lost batch leaves the table of the one before."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("now")).select(*keys, *[F.col("now")[c].alias(c) for c in rest])


def hourly(stream: DataFrame) -> DataFrame:
    """Events and summed value in cents of each hour and type."""
    at = F.window("at", "1 hour")
    return stream.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("hour"), "event_type", "n", "cents")


def first_seen(stream: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), late: str = "60 days") -> DataFrame:
    """Keys, each once within the watermark: state older than `late` is let go."""
    return stream.withWatermark("at", late).select("at", *keys).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events with less than `gap` between neighbours."""
    w = F.session_window("at", gap)
    return stream.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


def voted(spark: SparkSession, sf_dir: str, n_items: int, folder: str | None = None) -> DataFrame:
    """The votes that stand after all toggles, kept by key as they stream in: for each (item, user, vote) the last event and the last "on".

    The state is two numbers a key; a batch writes the keys that it touched, whatever the history. The fold is the same one that
    feedback.fold_toggles() does over a whole table."""
    from tidewire.operators.feedback import standing

    stream = events(spark, sf_dir).where("event_type IN ('click', 'error', 'purchase')").select(
        F.col("event_id").alias("id"), F.expr(f"event_id % {int(n_items)}").alias("item_id"), "user_id", F.expr("CASE event_type WHEN 'click' THEN 'up' WHEN 'error' THEN 'down' ELSE 'save' END").alias("vote"), F.expr("event_id % 4 <> 3").alias("on")
    )
    last = stream.groupBy("item_id", "user_id", "vote").agg(F.max(F.struct("id", "on")).alias("last"), F.max(F.when(F.col("on"), F.col("id"))).alias("on_id"))
    return standing(upserted(last, ("item_id", "user_id", "vote"), folder))


def healthy(stream: DataFrame, folder: str | None = None, late: int = 1_000_000) -> DataFrame:
    """Health counters of each source as its fetches (source_id, event_id, event_type) stream in: successes in all, and failures since the last success.

    Fetches are in the order of their numbers, whatever order they come in. The state of a source is bounded: a count of successes, the number of
    the last one, the numbers of failures after it that are within `late` of the highest number seen, and a count of the older ones. A success that comes
    more than `late` numbers behind the highest one seen is counted and clears nothing. The result is that of the whole table unless fetches come that late."""

    def fold(key, frames, state):
        import numpy as np
        import pandas as pd

        ok, total, older, top, fails = state.get if state.exists else (-1, 0, 0, -1, [])
        settled, fails = top - late, np.array(fails, dtype=np.int64)
        for pdf in frames:
            ids, bad = pdf["event_id"].to_numpy(dtype=np.int64), (pdf["event_type"] == "error").to_numpy()
            total += int((~bad).sum())
            good = ids[~bad & (ids > settled)]
            if len(good) and good.max() > ok:
                ok, older = int(good.max()), 0
            fails = np.concatenate([fails, ids[bad]])
            fails, top = fails[fails > ok], max(top, int(ids.max()))
        settled = top - late
        older, fails = older + int((fails <= settled).sum()), fails[fails > settled]
        state.update((ok, total, older, top, fails.tolist()))
        yield pd.DataFrame({"source_id": [key[0]], "failures": [older + len(fails)], "total": [total]})

    keyed = stream.where("source_id IS NOT NULL AND event_id IS NOT NULL").select("source_id", "event_id", "event_type")
    state = "ok long, total long, older long, top long, fails array<long>"
    out = keyed.groupBy("source_id").applyInPandasWithState(fold, "source_id string, failures long, total long", state, "update", "NoTimeout")
    return upserted(out, ("source_id",), folder)


def fetches(stream: DataFrame) -> DataFrame:
    """The event stream as fetches of fifty sources, each with its cadence."""
    cadence = F.expr("CASE user_id % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' ELSE 'weekly' END")
    return stream.select(F.expr("concat('u', user_id % 50)").alias("source_id"), cadence.alias("cadence"), "event_id", "event_type", "ts")


#: The part of time that a fetch of each cadence covers, and its length.
BUCKETS = {"hourly": ("hour", "INTERVAL 1 HOUR"), "daily": ("day", "INTERVAL 1 DAY"), "weekly": ("week", "INTERVAL 7 DAYS")}


def cadence_runs(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """What each cadence's own job has fetched (source_id, cadence, ts, event_id): cadence, source_id, began, due_at, n, last_id.

    There is a job for each cadence, with its own progress in `folder`. Its table has a row for each source and bucket (hours, days, weeks from Monday
    on), upserted by that key: a run that finds nothing new writes nothing, and late rows raise the count of their own bucket. Rows without time go."""
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = []
    for cadence, (part, length) in BUCKETS.items():
        began = F.date_trunc(part, "ts").cast("timestamp_ntz").alias("began")
        sums = rows.where((F.col("cadence") == cadence) & F.col("ts").isNotNull()).groupBy("source_id", began).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
        done = upserted(sums, ("source_id", "began"), f"{folder}/{cadence}")
        out.append(done.select(F.lit(cadence).alias("cadence"), "source_id", "began", (F.col("began") + F.expr(length)).alias("due_at"), "n", "last_id"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def pending_items(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    """Items (id, published_at, embedding) as they stream in, enriched and embedded, but for those that `members` (id) has."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    items = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), F.expr(PUBLISHED).alias("published_at"))
    known = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding")
    return items.join(known, "id").join(members.select("id"), "id", "left_anti")


def placed(stream: DataFrame, members: DataFrame, distance: float = JOIN_DISTANCE, hours: int = WINDOW_HOURS, folder: str | None = None) -> DataFrame:
    """Streamed items (id, published_at, embedding) with the event of their nearest member (id, cluster_id, published_at, embedding) within `hours`
    of their own date and within `distance`: id, event, distance; both null where there is none.

    The band lies around each item's own date, so that one which comes late finds its cohort; there is no watermark that would drop it. Each batch is an
    exact band join of its items with the members as they are then: the members of a time bucket are held in blocks, the batch's items stream by. An item
    without date or vector has no event; of ties the member with the least id. A batch that is run again replaces its own rows."""
    spark = stream.sparkSession
    folder = folder or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    have = members.where("embedding IS NOT NULL AND cluster_id IS NOT NULL AND published_at IS NOT NULL")
    held, events = have.select("id", vectors.timed(have), "embedding"), have.select(F.col("id").alias("o_id"), F.col("cluster_id").alias("event"))

    def put(batch: DataFrame, number: int) -> None:
        asks = batch.where("embedding IS NOT NULL AND published_at IS NOT NULL")
        near = vectors.nearest_of(held, asks.select("id", vectors.timed(asks), "embedding"), hours, 1).where(F.col("distance") <= distance)
        near = near.select(F.col("q_id").alias("id"), F.col("id").alias("o_id"), "distance").join(events, "o_id")
        batch.select("id").join(near, "id", "left").select("id", "event", "distance").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    event = dict(members.dtypes)["cluster_id"]
    return spark.read.schema(f"id {dict(stream.dtypes)['id']}, event {event}, distance double").parquet(f"{folder}/out")


def cohorts(stream: DataFrame, kinds: tuple[str, ...] = ("purchase",), folder: str | None = None) -> DataFrame:
    """Each item with the day it belongs to by its own date, however late it comes: there is no watermark that would drop it."""
    rows = stream.where(F.col("event_type").isin(*kinds)).select(F.col("event_id").alias("id"), F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("cohort"))
    return drain(rows, "append", folder)


def due(now: Column, cadence: str = "cadence") -> Column:
    """Whether a fetch of a cadence is due in the hour of `now`: hourly always, daily in the first hour of a day, weekly in that of a Monday."""
    first = F.hour(now) == 0
    return F.when(F.col(cadence) == "hourly", True).when(F.col(cadence) == "daily", first).when(F.col(cadence) == "weekly", first & (F.weekday(now) == 0)).otherwise(False)
