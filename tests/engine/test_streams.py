"""Streams over several batches, and runs again: the same tables as a fold over everything at once."""

import datetime as dt
import math

import pytest

from tidewire.operators import digest
from tidewire.sources.backfill import Paged
from tidewire.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def streamed(spark, folder, batches, schema, run):
    """`run` over a stream of one file a batch, called after each; the last result."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        got = run(spark.readStream.schema(schema).parquet(folder))
    return got


def health(rows):
    out = {}
    for s in {r[0] for r in rows if r[0] is not None}:
        own = [r for r in rows if r[0] == s and r[1] is not None]
        ok = max([r[1] for r in own if r[2] != "error"], default=-1)
        out[s] = (sum(r[2] == "error" and r[1] > ok for r in own), sum(r[2] != "error" for r in own))
    return out


@pytest.mark.parametrize("late", [1_000_000, 6])
def test_health_by_batches(spark, tmp_path, late):
    """Rows of a batch come in any order, those of batches up to `late` numbers behind; the state keeps what is that recent, and counts."""
    kinds = ["error", "view", "error", "error", "error", "error", "error", "view", "error", "error", "error", "error"]
    rows = [(s, i, kinds[(i + k) % 12] if s != "down" else "error") for k, s in enumerate(("a", "b", "down")) for i in range(48)] + [(None, 1, "view")]
    order = [[r for r in rows if r[1] // 12 == b or (b and r[1] == b * 12 - 2)] for b in range(4)]
    order = [[r for r in o if b == 3 or r[1] != b * 12 + 10] for b, o in enumerate(order)]
    got = streamed(spark, str(tmp_path / "in"), [o[::-1] for o in order], "source_id string, event_id long, event_type string", lambda s: jobs.healthy(s, "file://" + str(tmp_path / "job"), late))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == health([r for o in order for r in o])


def test_cadences(spark, tmp_path):
    """Each cadence has buckets of its own; a run again changes nothing; late rows go to their own bucket, rows without time go."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    first = [("s1", "hourly", at(1.2), 1), ("s1", "hourly", at(1.9), 2), ("s2", "daily", at(3), 3), ("s3", "weekly", at(24 * 6.5), 4), ("s1", "hourly", None, 5)]
    second = [("s1", "hourly", at(1.5), 6), ("s2", "daily", at(30), 7), ("s3", "weekly", at(24 * 7), 8), (None, "daily", at(3), 9)]
    schema, folder = "source_id string, cadence string, ts timestamp_ntz, event_id long", "file://" + str(tmp_path / "job")
    run = lambda s: jobs.cadence_runs(s, folder)
    want = {("hourly", "s1", at(1), at(2), 2, 2), ("daily", "s2", at(0), at(24), 1, 3), ("weekly", "s3", at(0), at(168), 1, 4)}
    assert {tuple(r) for r in streamed(spark, str(tmp_path / "in"), [first], schema, run).collect()} == want
    before = sorted(p.name for p in (tmp_path / "job").rglob("*.parquet"))
    assert {tuple(r) for r in run(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).collect()} == want
    assert sorted(p.name for p in (tmp_path / "job").rglob("*.parquet")) == before
    want = (want - {("hourly", "s1", at(1), at(2), 2, 2)}) | {("hourly", "s1", at(1), at(2), 3, 6), ("daily", "s2", at(24), at(48), 1, 7), ("weekly", "s3", at(168), at(336), 1, 8), ("daily", None, at(0), at(24), 1, 9)}
    assert {tuple(r) for r in streamed(spark, str(tmp_path / "in"), [second], schema, run).collect()} == want


def test_late_items_find_their_cohort(spark, tmp_path):
    """An item joins the event of its nearest member within the hours around its own date, in whichever batch it comes."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    v = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    vector = "id long, cluster_id long, published_at timestamp_ntz, embedding array<double>"
    members = [(1, 10, at(0), v(0)), (2, 20, at(100), v(2)), (3, 30, at(500), v(0)), (4, None, at(0), v(1)), (5, 50, None, v(1)), (6, 60, at(0), None), (7, 10, at(0), v(0))]
    stream = [
        [(11, at(510), v(1)), (12, at(20), v(90))],
        [(13, at(72), v(0.1)), (14, at(72.5), v(0)), (15, None, v(0)), (16, at(1), None)],
        [(17, at(28), v(1.5)), (18, at(0), v(44)), (1, at(0), v(0.5))],
    ]
    known = spark.createDataFrame(members, vector)
    run = lambda s: jobs.placed(s, known, 0.25, 72, "file://" + str(tmp_path / "job"))
    got = streamed(spark, str(tmp_path / "in"), stream, "id long, published_at timestamp_ntz, embedding array<double>", run)

    def nearest(i, t, x):
        if t is None or x is None:
            return None
        near = [(round(1 - sum(a * b for a, b in zip(x, m[3], strict=True)), 6), m[0], m[1]) for m in members if m[0] != i and m[1] and m[2] and m[3] and abs((m[2] - t).total_seconds()) <= 72 * 3600]
        return min((n for n in near if n[0] <= 0.25), default=(None, None, None))[2]

    assert {r["id"]: r["event"] for r in got.collect()} == {i: nearest(i, t, x) for b in stream for i, t, x in b}
    assert run(spark.readStream.schema("id long, published_at timestamp_ntz, embedding array<double>").parquet(str(tmp_path / "in"))).count() == 9
    assert got.where("id = 14 AND event = 20").count() == 1 and got.where("id = 11 AND event = 30").count() == 1


def test_pool_of_a_window_is_replaced(spark, tmp_path):
    """Runs within an hour write one window; a run an hour later another, and the first stays."""
    src = spark.createDataFrame([("s", ["news"], True)], "id string, tags array<string>, curated boolean")
    schema = "id long, cluster_id long, source_id string, importance int, published_at timestamp_ntz, enriched_at timestamp_ntz"
    items = lambda n: spark.createDataFrame([(i, None, "s", i, T0 + dt.timedelta(hours=i), T0) for i in range(n)], schema)
    folder = "file://" + str(tmp_path / "pools")
    read = lambda df: {(r["window"], r["id"]) for r in df.collect()}
    assert read(digest.written_pool(items(7), src, "2024-01-01 10:05:00", folder)) == {("2024-01-01-10", i) for i in range(7)}
    assert read(digest.written_pool(items(8), src, "2024-01-01 10:55:00", folder)) == {("2024-01-01-10", i) for i in range(8)}
    both = read(digest.written_pool(items(12), src, "2024-01-01 11:00:00", folder))
    assert both == {("2024-01-01-10", i) for i in range(8)} | {("2024-01-01-11", i) for i in range(11)}
    assert read(digest.written_pool(items(2), src, "2024-01-01 10:59:59", folder)) == {("2024-01-01-11", i) for i in range(11)}  # too few now


def test_paged_backfill(spark, tmp_path):
    """Pages by range, a hard cap, a window of dates; a run again reads nothing twice, and what was added comes next."""
    spark.dataSource.register(Paged)
    at = lambda i: None if i % 7 == 3 else T0 + dt.timedelta(hours=i)
    schema = "n long, at timestamp_ntz, other string, `select` string"
    src, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    put = lambda ids: spark.createDataFrame([(i, at(i or 0), f"x{i}", None) for i in ids], schema).repartition(3).write.mode("append").parquet(src)
    put([*range(5, 60), None, 12, 12])
    options = {"path": src, "key": "n", "size": "10"}
    ids = lambda df: sorted(r["n"] for r in df.collect())
    full = spark.read.format("paged").options(**options).load()
    assert ids(full) == sorted([*range(5, 60), 12, 12]) and full.rdd.getNumPartitions() == 6
    assert full.where("n = 9").select("at", "other", "select").head() == (at(9), "x9", None)
    window = {"at": "at", "since": "2024-01-01T10:00:00", "until": "2024-01-02"}
    assert ids(spark.read.format("paged").options(**options, **window).load()) == sorted([i for i in range(5, 60) if i % 7 == 3 or 10 <= i <= 24] + [12, 12])
    assert ids(spark.read.format("paged").options(**options, most="15").load()) == list(range(45, 60))
    assert ids(spark.read.format("paged").options(**options, most="0").load()) == []
    with pytest.raises(Exception, match="need the column"):
        spark.read.format("paged").options(**options, since="2024-01-01").load().count()

    def run():
        stream = spark.readStream.format("paged").options(**options, most="15").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
        return ids(spark.read.parquet(out))

    assert run() == list(range(45, 60)) == run()
    put(range(60, 93))
    assert run() == list(range(45, 93)) == run()


def test_paged_backfill_of_an_empty_table(spark, tmp_path):
    spark.dataSource.register(Paged)
    spark.createDataFrame([], "n long, at timestamp_ntz").write.parquet(str(tmp_path / "in"))
    df = spark.read.format("paged").options(path=str(tmp_path / "in"), key="n").load()
    assert df.columns == ["n", "at"] and df.count() == 0
