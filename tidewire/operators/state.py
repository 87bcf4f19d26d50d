"""Small state: policy versions, review runs, digests, quality log, collections, resets and removals, each as a fold or a rewrite of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.content import short_hash


def committed(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """Versions (skill, version, content, committed_at) after commits (id, skill, content, committed_at): each takes the next number of its
    skill, in order of time and id."""
    last = versions.groupBy("skill").agg(F.max("version").alias("last"))
    place = F.row_number().over(Window.partitionBy("skill").orderBy("committed_at", "id"))
    new = commits.withColumn("_n", place).join(last, "skill", "left").select("skill", (F.coalesce("last", F.lit(0)) + F.col("_n")).cast("int").alias("version"), "content", "committed_at")
    return versions.select("skill", "version", "content", "committed_at").unionByName(new)


def seeded(versions: DataFrame, defaults: DataFrame, now: str) -> DataFrame:
    """Versions, with version 1 from `defaults` (skill, content) for skills that have none."""
    new = defaults.join(versions.select("skill").distinct(), "skill", "left_anti")
    return versions.unionByName(new.select("skill", F.lit(1).alias("version"), "content", F.lit(now).cast("timestamp_ntz").alias("committed_at")))


def active(versions: DataFrame) -> DataFrame:
    """The latest version of each skill, and its short hash."""
    best = versions.groupBy("skill").agg(F.max_by(F.struct("version", "content", "committed_at"), "version").alias("v"))
    return best.select("skill", "v.version", "v.content", short_hash("v.content").alias("hash"), "v.committed_at")


NEEDED_VOTES = 5
#: What a run may become from what it is.
STEPS = {"running": ("proposed", "failed"), "proposed": ("applied", "rejected")}


def may_iterate(votes: DataFrame) -> DataFrame:
    """One row: how many up and down votes there are, and whether that is enough to begin a run."""
    n = F.count_if(F.col("vote").isin("up", "down"))
    return votes.agg(n.alias("votes"), (n >= NEEDED_VOTES).alias("allowed"))


def runs(events: DataFrame) -> DataFrame:
    """Where each run stands after its events (run_id, skill, at, step): running, then proposed or failed, then applied or rejected.

    A step that the state before doesn't allow changes nothing: the first end of each phase counts."""
    first = lambda *steps: F.min(F.when(F.col("step").isin(*steps), F.struct("at", "step")))
    agg = events.groupBy("run_id", "skill").agg(F.min(F.when(F.col("step") == "running", F.col("at"))).alias("began"), first(*STEPS["running"]).alias("mid"), first(*STEPS["proposed"]).alias("end"))
    open_ = agg.where("began IS NOT NULL")
    status = F.when(F.col("mid").isNull(), "running").when((F.col("mid.step") == "failed") | F.col("end").isNull() | (F.col("end.at") < F.col("mid.at")), F.col("mid.step")).otherwise(F.col("end.step"))
    return open_.select("run_id", "skill", F.col("began").alias("created_at"), status.alias("status"))


def latest_run(of: DataFrame, status: str | None = None) -> DataFrame:
    """The latest run of each skill, of one status if given."""
    rows = of if status is None else of.where(F.col("status") == status)
    return rows.groupBy("skill").agg(F.max(F.struct("created_at", "run_id", "status")).alias("r")).select("skill", "r.run_id", "r.status", "r.created_at")


def run_history(of: DataFrame, limit: int = 20) -> DataFrame:
    """The `limit` latest finished runs of each skill."""
    place = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("created_at"), F.desc("run_id")))
    return of.where(F.col("status").isin("applied", "rejected", "failed")).withColumn("place", place).where(F.col("place") <= limit)


def digests_after(drafts: DataFrame) -> DataFrame:
    """Digests, one for each (kind, locale, period_start), after drafts (id, ..., force) in order of id: the first makes it, later ones
    replace it only with force. A draft of fewer than `least` stories never comes here: see digest.newsletter()."""
    key = ["kind", "locale", "period_start"]
    first = F.min("id").over(Window.partitionBy(*key))
    counts = drafts.withColumn("_first", first).where(F.col("force") | (F.col("id") == F.col("_first")))
    cols = [c for c in drafts.columns if c not in (*key, "force")]
    best = counts.groupBy(*key).agg(F.max_by(F.struct(*cols), "id").alias("d"), F.count("*").alias("writes"))
    return best.select(*key, *[f"d.{c}" for c in cols], "writes")


def column_list(digests: DataFrame, page: int = 1, size: int = 60) -> DataFrame:
    """A page of daily columns, the latest first."""
    rows = digests.where("kind = 'daily' AND locale = 'zh' AND column_title IS NOT NULL")
    return rows.orderBy(F.desc("period_start"), F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def column_of(digests: DataFrame, day: str) -> DataFrame:
    """The latest daily column of a day."""
    since = F.lit(day).cast("timestamp_ntz")
    within = (F.col("period_start") >= since) & (F.col("period_start") < since + F.expr("INTERVAL 1 DAY"))
    return column_list(digests.where(within), 1, 1)


def qc_log(checked: DataFrame, layer: Column) -> DataFrame:
    """A row for each text with hits (id, hits, as phrases() gives them): whether each layer passed, and the hits with their layer.

    `layer` gives the layer, 1 or 2, of a hit's phrase column."""
    hit = checked.where(F.size("hits") > 0).select("id", F.explode("hits").alias("h"))
    rows = hit.select("id", F.col("h.phrase").alias("phrase"), F.col("h.at").alias("at"), F.col("h.snippet").alias("snippet")).withColumn("layer", layer)
    return rows.groupBy("id").agg(
        (F.count_if(F.col("layer") == 1) == 0).alias("l1_pass"), (F.count_if(F.col("layer") == 2) == 0).alias("l2_pass"), F.array_sort(F.collect_list(F.struct("layer", "at", "phrase", "snippet"))).alias("hits")
    )


def reset(rows: DataFrame, column: str, where: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `column` null where the test holds, and one row with the number of those that it was taken from."""
    test = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    hit = F.coalesce(test, F.lit(False)) & F.col(column).isNotNull()
    return rows.withColumn(column, F.when(~hit, F.col(column))), rows.agg(F.count_if(hit).alias("n"))


def removal_plan(sources: DataFrame, items: DataFrame, remove: tuple[str, ...], disable: tuple[str, ...]) -> DataFrame:
    """Sources to remove or to disable, their items, and whether it is safe: only what has no items may be removed."""
    asked = sources.where(F.col("id").isin(*remove, *disable)).select("id", F.when(F.col("id").isin(*remove), "remove").otherwise("disable").alias("action"))
    n = items.where(F.col("source_id").isin(*remove, *disable)).groupBy("source_id").agg(F.count("*").alias("n"))
    rows = asked.join(n, F.col("id") == F.col("source_id"), "left").select("id", "action", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return rows.withColumn("safe", (F.col("action") == "disable") | (F.col("n") == 0))


def removed(sources: DataFrame, health: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and health after a plan; an error, and no change, if any of it isn't safe."""
    unsafe = [r["id"] for r in plan.where("NOT safe").select("id").limit(20).collect()]
    if unsafe:
        raise ValueError(f"sources with items can only be disabled: {unsafe}")
    gone = plan.where("action = 'remove'").select("id")
    off = plan.where("action = 'disable'").select(F.col("id").alias("off_id"))
    left = sources.join(gone, "id", "left_anti").join(off, F.col("id") == F.col("off_id"), "left")
    return left.withColumn("enabled", F.col("enabled") & F.col("off_id").isNull()).drop("off_id"), health.join(gone, health["source_id"] == gone["id"], "left_anti")


def collections_after(ops: DataFrame) -> DataFrame:
    """Collections (user_id, collection_id, name, pinned) after operations in order of id: (id, user_id, collection_id, op, name, pinned).

    create and update set name and pinned where given, delete ends a collection, and a later create begins it again. A name is
    trimmed; one of no or more than 64 characters makes the operation invalid, and of two equal names of a user the later
    collection's creation is invalid."""
    name = F.trim("name")
    valid = F.col("op").isin("delete") | F.col("name").isNull() & (F.col("op") == "update") | F.length(name).between(1, 64)
    rows = ops.withColumn("name", name).where(F.coalesce(valid, F.lit(False)))
    key = ["user_id", "collection_id"]
    ended = rows.groupBy(*key).agg(F.max(F.when(F.col("op") == "delete", F.col("id"))).alias("ended"))
    live = rows.join(ended, key).where("op <> 'delete' AND (ended IS NULL OR id > ended)")
    began = live.groupBy(*key).agg(F.min(F.when(F.col("op") == "create", F.col("id"))).alias("began"))
    live = live.join(began, key).where("began IS NOT NULL AND id >= began")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("id")))
    now = live.groupBy(*key).agg(last("name").alias("name"), F.coalesce(last("pinned"), F.lit(False)).alias("pinned"), F.min("id").alias("began"))
    first = F.row_number().over(Window.partitionBy("user_id", "name").orderBy("began"))
    return now.withColumn("_n", first).where("_n = 1").drop("_n", "began")


def moved(votes: DataFrame, moves: DataFrame) -> DataFrame:
    """Saves after the last move (id, user_id, item_id, collection_id or null for the inbox) of each."""
    last = moves.groupBy(F.col("user_id").alias("m_user"), F.col("item_id").alias("m_item")).agg(F.max_by("collection_id", "id").alias("to"))
    rows = votes.join(last, (F.col("user_id") == F.col("m_user")) & (F.col("item_id") == F.col("m_item")) & (F.col("vote") == "save"), "left")
    return rows.withColumn("collection_id", F.when(F.col("m_user").isNotNull(), F.col("to")).otherwise(F.col("collection_id"))).drop("m_user", "m_item", "to")


def floored_tier(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items of sources that must never be excluded are at least in tier "all"."""
    keep = sources.where("never_exclude").select(F.col("id").alias("k_id"))
    rows = items.join(F.broadcast(keep), F.col("source_id") == F.col("k_id"), "left")  # a row a source
    return rows.withColumn("tier", F.when((F.col("tier") == "excluded") & F.col("k_id").isNotNull(), "all").otherwise(F.col("tier"))).drop("k_id")


def stale_scores(items: DataFrame) -> DataFrame:
    """Enriched items whose axes or reasons are missing: `hkr` JSON, null or without reasonsZh or reasonsEn, or a null reasoning."""
    missing = F.col("hkr").isNull() | F.col("reasoning_zh").isNull() | F.col("reasoning_en").isNull()
    for key in ("reasonsZh", "reasonsEn"):
        missing |= ~F.array_contains(F.json_object_keys("hkr"), key)
    return items.where(F.col("enriched_at").isNotNull() & missing)


def floored_backfill(items: DataFrame) -> DataFrame:
    """The same floor by the source's name: channels, whose id ends in -yt, are never excluded."""
    return items.withColumn("tier", F.when((F.col("tier") == "excluded") & F.endswith("source_id", F.lit("-yt")), "all").otherwise(F.col("tier")))
