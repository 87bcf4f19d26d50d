"""The replay of event assignment in order: the same events as one item after another, without walking.

One after another by id, an item joins the event of its nearest item in an event, within the distance and the hours; else
it forms an event with its nearest item in none, which is then in that event before its own turn; else it is alone. At an
item's turn all earlier items are in events, and of the later ones those that an earlier item took. So an item with an earlier
neighbour always joins. Only a first item, one without earlier neighbours, takes another: its nearest, unless one of its
neighbours was taken before its turn. Whether it takes hence depends on other first items that would take a neighbour of
it, and rounds settle all first items whose earlier rivals are settled. Then each item's choice is known, and chains of
choices are followed by jumps.

Neighbours are never listed: comparisons go by pairs of blocks and give each item's nearest of a kind. Only first items with those that may be
taken are listed as pairs; first items are no neighbours of each other, so that few of them are near one other item.
Rounds are as many as the longest chain of rivals, jumps a logarithm of the longest chain of choices; each is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.sources.shared import cut

from .cluster import JOIN_DISTANCE, WINDOW_HOURS
from .vectors import Block, by_block_pairs, timed

NEVER = (1 << 63) - 1
Allowed = Callable[[Block, Block], np.ndarray]


def _nearest(rows: DataFrame, hours: int, most: float, kinds: dict[str, Allowed], block: int) -> DataFrame:
    """(id, and for each kind a struct of distance and o_id): the nearest of `rows` that a kind allows; ties by id."""

    def best(a: Block, b: Block, d: np.ndarray, near: np.ndarray) -> Iterator[dict]:
        for kind, allowed in enumerate(kinds.values()):
            own = np.where(near & (d <= most) & allowed(a, b), d, np.inf)
            least = own.min(axis=1)
            hit = np.flatnonzero(np.isfinite(least))
            if len(hit):
                ids = np.where(own[hit] == least[hit, None], b["id"][None, :], NEVER).min(axis=1)
                yield {"id": a["id"][hit], "kind": np.full(len(hit), kind, dtype=np.int32), "o_id": ids, "distance": least[hit]}

    def compare(a: Block, b: Block | None, d: np.ndarray, near: np.ndarray) -> Iterator[dict]:
        if b is None:
            yield from best(a, a, d, near)
        else:
            yield from best(a, b, d, near)
            yield from best(b, a, d.T, near.T)

    local = by_block_pairs(rows, hours, compare, "id long, kind int, o_id long, distance double", block)
    pick = lambda k: F.min(F.when(F.col("kind") == k, F.struct("distance", "o_id")))
    return local.groupBy("id").agg(*[pick(k).alias(name) for k, name in enumerate(kinds)])


def _rivals(rows: DataFrame, hours: int, most: float, block: int) -> DataFrame:
    """(id, w): pairs of a first item and one that may be taken, within the distance and the hours."""

    def compare(a: Block, b: Block | None, d: np.ndarray, near: np.ndarray) -> Iterator[dict]:
        for x, y, e, n in [(a, a, d, near)] if b is None else [(a, b, d, near), (b, a, d.T, near.T)]:
            r, c = np.nonzero(n & (e <= most) & x["first"][:, None] & ~y["first"][None, :])
            if len(r):
                yield {"id": x["id"][r], "w": y["id"][c]}

    return by_block_pairs(rows, hours, compare, "id long, w long", block)


def _takers(firsts: DataFrame, rivals: DataFrame) -> DataFrame:
    """(id, w): the first items that take their nearest. One does unless an earlier one that takes a neighbour of it does."""
    other = firsts.select(F.col("id").alias("rival"), "w")
    ahead = cut(rivals.join(other, "w").where("rival < id").select("id", "rival").distinct())
    state = cut(firsts.select("id", "w", F.lit(None).cast("boolean").alias("takes")))
    while not state.where("takes IS NULL").isEmpty():
        known = ahead.join(state.select(F.col("id").alias("rival"), "takes"), "rival").groupBy("id").agg(F.coalesce(F.bool_or("takes"), F.lit(False)).alias("beaten"), F.bool_or(F.col("takes").isNull()).alias("wait"))
        verdict = F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.coalesce("wait", F.lit(False)), True)
        state = cut(state.join(known, "id", "left").select("id", "w", F.coalesce("takes", verdict).alias("takes")))
    return state.where("takes").select("id", "w")


def _followed(choices: DataFrame) -> DataFrame:
    """(id, cluster_id): where each chain of choices (id, to) ends, by jumps."""
    while True:
        on = choices.select(F.col("id").alias("to"), F.col("to").alias("next"))
        further = cut(choices.join(on, "to").select("id", "to", "next"))
        choices = further.select("id", F.col("next").alias("to"))
        if further.where("next != to").isEmpty():
            return choices.select("id", F.col("to").alias("cluster_id"))


def in_order(items: DataFrame, distance: float = JOIN_DISTANCE, hours: int = WINDOW_HOURS, most: int | None = None, block: int = 1024) -> DataFrame:
    """(id, cluster_id) of every embedded, enriched item after all events are taken apart and items are assigned by id, one after another; an
    event is named by the item that formed it.

    With `most`, what one pass over so many items leaves: those of the least ids, and what they took; an item depends on earlier ones alone."""
    own = items.where("embedding IS NOT NULL AND enriched_at IS NOT NULL")
    rows = cut(own.select("id", timed(own), "embedding"))
    earlier: Allowed = lambda a, b: b["id"][None, :] < a["id"][:, None]
    later: Allowed = lambda a, b: b["id"][None, :] > a["id"][:, None]
    near = cut(_nearest(rows, hours, distance, {"before": earlier, "after": later}, block))
    firsts = cut(near.where("before IS NULL").select("id", F.col("after.o_id").alias("w")))
    sides = firsts.select("id", F.lit(True).alias("first")).unionByName(firsts.select(F.col("w").alias("id"), F.lit(False).alias("first")).distinct())
    taken = cut(_takers(firsts, _rivals(rows.join(sides, "id"), hours, distance, block)))
    since = rows.join(taken.select(F.col("w").alias("id"), F.col("id").alias("since")), "id", "left").withColumn("since", F.coalesce("since", F.lit(NEVER)))
    there: Allowed = lambda a, b: (b["id"][None, :] > a["id"][:, None]) & (b["since"][None, :] < a["id"][:, None])
    also = _nearest(since, hours, distance, {"taken": there}, block)
    takers = taken.select("id", F.col("id").alias("own"))
    claimed = taken.select(F.col("w").alias("id"), F.col("id").alias("by"))
    every = rows.select("id").join(near, "id", "left").join(also, "id", "left").join(takers, "id", "left").join(claimed, "id", "left")
    if most is not None:
        turns = rows.select("id").orderBy("id").limit(most).agg(F.max("id").alias("last"))  # one row
        every = every.join(turns, (F.col("id") <= F.col("last")) | (F.col("by") <= F.col("last")))
    return _followed(every.select("id", F.coalesce("by", "own", F.least("before", "taken")["o_id"], "id").alias("to")))
