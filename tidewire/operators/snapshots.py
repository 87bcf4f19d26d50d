"""Sampling of archived snapshots, in order, at a cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.sources.shared import stored

_SECOND = 1_000_000


def sample(snapshots: DataFrame, cadence_hours: float = 84.0) -> DataFrame:
    """Snapshots (source, ts, digest) that are kept: those at least a cadence after the last kept one of their source whose
    digest no kept one has. Null times go; null digests never count as seen; of rows of one time the least digest counts, null first.

    The walk is guessed and mended. A guess takes the digests kept by the guess before as seen (the first one knows of none) and
    then needs no order: each time has one next time, a cadence later, and doubled pointers reach all times from the first. A guess is
    the walk up to where the digests that it keeps itself would have changed it; the next guess goes on from there, for the sources
    where that is anywhere. A guess takes as many rounds as the logarithm of its longest chain. Clashes of digests far from
    each other mend in one guess; there are at most as many guesses as rows kept of a source, and one more.
    Without a cadence above 0 time doesn't bind: each digest stays once, and all rows without one.
    """
    rows = snapshots.select("source", "ts", "digest").filter(F.col("ts").isNotNull())
    if cadence_hours <= 0:
        known = rows.filter(F.col("digest").isNotNull()).groupBy("source", "digest").agg(F.min("ts").alias("ts"))
        return rows.filter(F.col("digest").isNull()).unionByName(known)
    step = round(cadence_hours * 3600 * _SECOND)
    at = _micros(rows, "ts").alias("at")
    # One column that a join compares as it is, null or not.
    todo = stored(rows.groupBy(F.struct("source").alias("key"), at, "digest").agg(F.min("ts").alias("ts")))
    kept = stored(_chain(todo, step))
    seen = _seen(kept)
    parts = stored(_clashes(kept, seen).groupBy("key").agg(F.min("at").alias("parts")))
    while not parts.isEmpty():
        # The last row before a guess goes wrong is settled, and the first of the next guess.
        start = stored(kept.join(parts, "key").filter("at < parts").groupBy("key").agg(F.max("at").alias("start")))
        todo = stored(todo.join(start, "key").filter("at >= start").drop("start"))
        before = stored(seen.join(start.select("key"), "key"))
        free = todo.join(before, ["key", "digest"], "left").filter("since IS NULL OR at <= since").drop("since")
        guess = _chain(free, step)
        kept = stored(kept.join(start, "key", "left").filter("start IS NULL OR at < start").drop("start").unionByName(guess))
        seen = _seen(kept)
        freed = todo.join(before, ["key", "digest"]).filter("at > since").join(seen.withColumnRenamed("since", "now"), ["key", "digest"], "left").filter("now IS NULL OR at <= now")
        wrong = _clashes(kept.join(start.select("key"), "key"), seen).select("key", "at").unionByName(freed.select("key", "at"))
        parts = stored(wrong.groupBy("key").agg(F.min("at").alias("parts")))
    return kept.select("key.source", "ts", "digest")


def _seen(kept: DataFrame) -> DataFrame:
    """(key, digest, since): when each digest was first kept."""
    return kept.filter(F.col("digest").isNotNull()).groupBy("key", "digest").agg(F.min("at").alias("since"))


def _clashes(kept: DataFrame, seen: DataFrame) -> DataFrame:
    """Kept rows whose digest an earlier kept row has."""
    return kept.join(seen, ["key", "digest"]).filter("at > since")


def _micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970: of a time without zone by its own clock, so that no change of clocks counts."""
    if dict(rows.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(F.col(name).cast("timestamp"))
    parts = f"{name} - TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    part = lambda unit: F.expr(f"extract({unit} FROM {parts})")
    minutes = (part("DAY").cast("long") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * (60 * _SECOND) + (part("SECOND") * _SECOND).cast("long")


def _chain(rows: DataFrame, step: int) -> DataFrame:
    """Of each key the first time, then the first one at least a step later, and so on, with its least digest.

    A round marks what the marked times point to, and doubles all pointers: it is done when no marked time points on."""
    points = rows.groupBy("key", "at").agg(F.min(F.struct("digest", "ts")).alias("one")).select("key", "at", "one.digest", "one.ts")
    first = points.groupBy("key").agg(F.min("at").alias("first"))
    state = stored(_next(points, step).join(first, "key").withColumn("on", F.col("at") == F.col("first")).drop("first"))
    while not state.filter("on AND to IS NOT NULL").isEmpty():
        hit = state.filter("on AND to IS NOT NULL").select("key", F.col("to").alias("at"), F.lit(True).alias("hit"))
        further = state.select("key", F.col("at").alias("to"), F.col("to").alias("beyond"))
        both = state.join(hit, ["key", "at"], "left").join(further, ["key", "to"], "left")
        state = stored(both.select("key", "at", "digest", "ts", F.col("beyond").alias("to"), (F.col("on") | F.col("hit").isNotNull()).alias("on")))
    return state.filter("on").select("key", "at", "digest", "ts")


def _next(points: DataFrame, step: int) -> DataFrame:
    """The points, each with `to`: the least time of its key that is at least a step later, else null.

    A cell is a step wide, so that a step later is in the next cell: there both sides are sorted by cell, not by key. Where the next
    cell has nothing late enough, it is the first time of a later one; a key has no more cells than steps in its span.
    """
    cell = F.expr(f"at div {step} - CASE WHEN at % {step} < 0 THEN 1 ELSE 0 END")
    there = points.select("key", cell.alias("cell"), F.col("at").alias("place"), F.col("at").alias("found"))
    asks = points.select("key", (cell + 1).alias("cell"), (F.col("at") + step).alias("place"), "at", "digest", "ts")
    down = Window.partitionBy("key", "cell").orderBy(F.col("place").desc(), F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = there.unionByName(asks, allowMissingColumns=True).withColumn("near", F.last("found", ignorenulls=True).over(down)).filter("at IS NOT NULL")
    line = Window.partitionBy("key").orderBy("cell")
    cells = points.groupBy("key", cell.alias("cell")).agg(F.min("at").alias("first"))
    later = F.when(F.lead("cell").over(line) > F.col("cell") + 1, F.lead("first").over(line)).otherwise(F.lead("first", 2).over(line))
    after = cells.select("key", (F.col("cell") + 1).alias("cell"), later.alias("later"))
    return near.join(after, ["key", "cell"]).select("key", "at", "digest", "ts", F.coalesce("near", "later").alias("to"))
