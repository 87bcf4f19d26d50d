"""Moves of single items against one after the other, blocks of comparisons against all pairs, the index, and state."""

import math
import random

import numpy as np
import pytest

from tidewire.operators import cluster, search, state, upkeep, vectors
from tidewire.operators.feed import FeedQuery
from tidewire.plans.views import Views
from tidewire.sources import fixtures as fx

DAY = "2024-01-{:02d} 00:00:00"
ITEM = "id long, published_at timestamp_ntz, embedding array<double>, cluster_id long, source_id string, enriched_at timestamp_ntz, cluster_verified_at timestamp_ntz"


def items(spark, n=60, seed=1, equal=False):
    import datetime as dt

    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = centres[r.randrange(8)]
        at = dt.datetime(2024, 1, 1 + r.randrange(20), r.randrange(24))
        v = centres[0] if equal and i % 3 == 0 else [x + r.gauss(0, 0.25) for x in c]
        rows.append((i, at, v, r.choice([i, i, i, r.randrange(n), None]), f"s{i % 3}", at if i % 9 else None, at if i % 11 == 0 else None))
    return rows, spark.createDataFrame(rows, ITEM).repartition(3)


def distance(a, b):
    return round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)


@pytest.mark.parametrize("block", [1024, 4])
def test_neighbours(spark, block):
    rows, df = items(spark, equal=True)
    want = []
    for a in rows:
        near = sorted((distance(a[2], b[2]), b[0]) for b in rows if a[0] != b[0] and abs((a[1] - b[1]).total_seconds()) <= 72 * 3600)
        want += [(a[0], o, d, k + 1) for k, (d, o) in enumerate(near[:3])]
    got = vectors.neighbours(df, 72, 3, block=block).select("id", "o_id", "distance", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert vectors.neighbours(df.limit(0), 72, 3).count() == 0


def walk(rows, cut=0.2):
    """One item after the other, by date and id."""
    event = {r[0]: r[3] for r in rows}
    size = lambda e: sum(x == e for x in event.values())
    single = [r for r in rows if r[3] is not None and size(r[3]) == 1 and r[6] is None and r[5] is not None]
    moved = {}
    for r in sorted(single, key=lambda r: (r[1], r[0])):
        if size(event[r[0]]) > 1:
            continue
        near = sorted((distance(r[2], o[2]), o[0]) for o in rows if o[0] != r[0] and event[o[0]] is not None and o[5] is not None and abs((o[1] - r[1]).total_seconds()) <= 72 * 3600)
        if near and near[0][0] <= cut:
            moved[r[0]] = (event[r[0]], event[near[0][1]])
            event[r[0]] = event[near[0][1]]
    return sorted((i, old, new) for i, (old, new) in moved.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_singles_moved(spark, seed):
    rows, df = items(spark, 80, seed)
    want = walk(rows)
    assert len(want) > 5
    assert sorted(map(tuple, upkeep.singles_moved(df, 0.2).collect())) == want


def test_search_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(20, 16))
    data = [(i, (centre[i % 20] + rng.normal(size=16) * 0.3).tolist()) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, embedding array<double>").repartition(4)
    asked = df.where("id % 50 = 0").selectExpr("id AS q_id", "embedding AS vector")
    exact = vectors.search_all(df, asked, 10)
    x = np.array([v for _, v in data])
    for q, near in {q: [r["id"] for r in sorted(exact.where(f"q_id = {q}").collect(), key=lambda r: r["rank"])] for q in (0, 50, 1950)}.items():
        d = np.round(-(x @ x[q]), 6)
        assert near == sorted(range(2000), key=lambda k: (d[k], k))[:10]
    assert sorted(map(tuple, vectors.search_all(df, asked, 10, block=7).collect())) == sorted(map(tuple, exact.collect()))
    index = vectors.Index(df, f"file://{tmp_path}/cells", 10, 0.95, cells=20, apart="id % 50 <> 0")
    near = index.search(asked)
    assert index.probes < 20 and index.stored.count() == 2000
    assert exact.join(near, ["q_id", "id"]).count() >= 0.9 * exact.count()  # on other askers than those it was tuned on
    assert sorted(map(tuple, index.search(asked, probes=20).collect())) == sorted(map(tuple, exact.collect()))
    assert vectors.search_all(df, asked.limit(0), 10).count() == 0 and vectors.search_all(df.limit(0), asked, 10).count() == 0
    assert vectors.Index(df.limit(0), f"file://{tmp_path}/none").search(asked).count() == 0 and index.search(asked.limit(0)).count() == 0


def test_vectors_that_cannot_be_compared(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "q_id long, vector array<double>")
    assert [tuple(r)[:2] for r in vectors.search_all(df, asked, 1).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="can't be compared"):
        vectors.search_all(df.union(spark.createDataFrame([(4, [1.0])], df.schema)).coalesce(1), asked, 1).collect()
    with pytest.raises(Exception, match="can't be compared"):
        vectors.search_all(df, spark.createDataFrame([(7, [1.0, 0.0, 0.0])], asked.schema), 1).collect()


@pytest.mark.parametrize("block", [5, 1024])
def test_neighbours_in_all_cells(spark, block):
    """With every cell asked, the band join by cells is the exact one; with those that tuning chose, most of it."""
    rows, df = items(spark, 150, 4)
    near = vectors.timed(df)
    flat = df.where("embedding IS NOT NULL").select("id", near, "embedding")
    centres = vectors.fit_cells(df, cells=8)
    asked = vectors.with_cells(flat, "embedding", centres, 8, "cells").selectExpr("id q_id", "at", "embedding vector", "cells")
    got = vectors.in_cells(vectors.indexed(flat, centres), asked, 3, cosine=True, hours=72, block=block)
    exact = vectors.neighbours(df, 72, 3).selectExpr("id q_id", "o_id id", "distance", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect())) and exact.count()
    some = vectors.neighbours_in_cells(df, 72, 3, cells=8)
    assert exact.join(some, ["q_id", "id"]).count() >= 0.9 * exact.count()
    assert vectors.neighbours_in_cells(df.limit(0), 72, 3).count() == 0


def test_search_modes(spark, sf_dir):
    v = Views(spark, sf_dir)
    asked = v.table("embeddings").where("vec_id % 50 = 0").selectExpr("vec_id q_id", "embedding vector")
    q = FeedQuery(now=fx.NOW, tier="all", search="event", limit=7)
    got = search.search("semantic", q, v.vectors, v.sources, v.clusters, asked)
    assert {r["count"] for r in got.groupBy("q_id").count().collect()} == {7}
    exact = vectors.search_all(v.found(include_excluded=True), asked, 7)
    assert sorted((r["q_id"], r["rank"], r["id"]) for r in got.collect()) == sorted((r["q_id"], r["rank"], r["id"]) for r in exact.collect())
    own = {r["id"]: r for r in v.items.collect()}
    for r in got.collect():
        item = own[r["id"]]
        assert r["title"] == (item["title_en"] or item["title_zh"] or item["title"]) and r["tier"] == (item["tier"] or "all") and r["importance"] == (item["importance"] or 0)
    assert search.search("semantic", FeedQuery(now=fx.NOW, search=" "), v.vectors, v.sources, v.clusters, asked).count() == 0
    lexical = search.search("lexical", q, v.items, v.sources, v.clusters, asked)
    assert sorted(r["id"] for r in lexical.collect()) == sorted(r["id"] for r in v.feed(tier="all", search="event", limit=7).collect())
    with pytest.raises(ValueError, match="mode"):
        search.search("other", q, v.items, v.sources, v.clusters, asked)


def test_survivors_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)], "cluster_a long, cluster_b long")
    assert {r["survivor"] for r in cluster.survivors(pairs).collect()} == {0}
    assert cluster.survivors(pairs.limit(0)).count() == 0


def test_removal_is_refused(spark):
    sources = spark.createDataFrame([("a", True), ("b", True)], "id string, enabled boolean")
    health = spark.createDataFrame([("a",), ("b",)], "source_id string")
    plan = state.removal_plan(sources, spark.createDataFrame([("a",)], "source_id string"), ("a",), ("b",))
    with pytest.raises(ValueError, match="disabled"):
        state.removed(sources, health, plan)


def test_runs_out_of_order(spark):
    rows = [(1, "s", "2024-01-01", "proposed"), (2, "s", "2024-01-01", "running"), (2, "s", "2024-01-02", "applied"), (3, "s", "2024-01-01", "running"), (3, "s", "2024-01-03", "proposed"), (3, "s", "2024-01-02", "applied"), (4, "s", "2024-01-01", "running"), (4, "s", "2024-01-02", "failed"), (4, "s", "2024-01-03", "applied")]
    got = {r["run_id"]: r["status"] for r in state.runs(spark.createDataFrame(rows, "run_id long, skill string, at string, step string")).collect()}
    assert got == {2: "running", 3: "proposed", 4: "failed"}
