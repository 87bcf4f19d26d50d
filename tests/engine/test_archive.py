"""Archive indexes, snapshot sampling, and streams that go on where they stopped."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewire.operators import snapshots
from tidewire.plans.registry import QUERIES
from tidewire.sources import archive, shared
from tidewire.streaming import jobs


def test_index(spark):
    full = '[["urlkey","timestamp","original","digest"],["k","20240101000000","http://a","D"],["k","20240102000000","http://b"]]'
    rows = spark.createDataFrame([(1, full), (2, "[]"), (3, '[["timestamp"]]'), (4, "no json"), (5, None)], "id long, payload string")
    got = [tuple(r) for r in archive.parse_index(rows).collect()]
    assert got == [(1, "20240101000000", "http://a", None, None, "D"), (1, "20240102000000", "http://b", None, None, None)]


def walk(rows, hours):
    kept, last, seen = [], {}, set()
    for s, ts, d in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2] or "")):
        if (s not in last or ts - last[s] >= dt.timedelta(hours=hours)) and (d is None or (s, d) not in seen):
            kept.append((s, ts, d))
            last[s] = ts
            seen.add((s, d))
    return kept


def test_sample(spark, sf_dir):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("a", at(h), f"d{h % 7}") for h in range(0, 300, 5)] + [("b", at(0), None), ("b", at(90), None), ("b", None, "x"), (None, at(1), "d"), (None, at(100), "d")]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, digest string")
    assert sorted(map(tuple, snapshots.sample(df, 24).collect()), key=str) == sorted(walk(rows, 24), key=str)
    assert snapshots.sample(df.limit(0)).count() == 0
    assert QUERIES["snapshot_sample"](spark, sf_dir).count() > 0


def test_sample_hot_source(spark):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("hot", at(h / 4), f"d{h % 11}" if h % 5 else None) for h in range(2000)] + [(s, at(h), f"d{h // 40}") for s in (None, "cold") for h in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, digest string").repartition(4)
    got = snapshots.sample(df, 30.5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(walk(rows, 30.5), key=str)
    assert "MapInPandas" not in got._jdf.queryExecution().toString()  # no walk of a whole source in one task
    assert sorted(map(tuple, snapshots.sample(df, 0).collect()), key=str) == sorted(walk(rows, 0), key=str)


def test_sample_random_walks(spark):
    """Few digests and many, ties of time, dense and sparse times, times before 1970: always the walk."""
    pick = random.Random(5)
    for n, digests, span in ((400, 4, 900), (300, 60, 3000), (200, 25, 300)):
        rows = [(pick.choice("ab"), dt.datetime(1969, 12, 20) + dt.timedelta(minutes=15 * pick.randrange(4 * span)), pick.choice([None, *map(str, range(digests))])) for _ in range(n)]
        df = spark.createDataFrame(rows, "source string, ts timestamp_ntz, digest string")
        assert sorted(map(tuple, snapshots.sample(df, 36).collect()), key=str) == sorted(walk(rows, 36), key=str)


def test_sample_rounds(spark, monkeypatch):
    """600 rows kept of a page that changes now and then: rounds follow the logarithm of the chain, not the rows kept."""
    rounds = []
    monkeypatch.setattr(snapshots, "stored", lambda df: rounds.append(1) or shared.stored(df))
    rows = [("s", dt.datetime(2015, 1, 1) + dt.timedelta(hours=20 * i), f"d{i // 3}") for i in range(1800)]
    got = snapshots.sample(spark.createDataFrame(rows, "source string, ts timestamp_ntz, digest string"), 24)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(walk(rows, 24), key=str) and got.count() == 600
    assert len(rounds) < 60, len(rounds)


def test_resume(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i % 3, dt.datetime(2024, 1, 1, i)) for i in ids], "user_id long, at timestamp")
    src, folder = str(tmp_path / "in"), "file://" + str(tmp_path / "job")
    for ids, want in ((range(2), 2), (range(6), 3)):
        rows(ids).write.mode("append").parquet(src)
        stream = spark.readStream.schema("user_id long, at timestamp").parquet(src)
        assert jobs.drain(jobs.first_seen(stream, ("user_id",)), "append", folder).count() == want


def test_upserts_touch_changed_keys_only(spark, tmp_path):
    """Batch by batch the table is that of the whole, and a batch writes the keys that it changed."""
    src, folder = str(tmp_path / "in"), "file://" + str(tmp_path / "job")
    everything = []
    for n, ids in enumerate((range(4), range(4, 6), range(6, 9))):
        rows = [(i % 3 if n != 1 else 7, dt.datetime(2024, 1, 1, i, 30), "click", float(i)) for i in ids]
        everything += rows
        spark.createDataFrame(rows, "user_id long, at timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("user_id long, at timestamp, event_type string, value double").parquet(src)
        total = stream.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
        got = jobs.upserted(total, ("user_id",), folder)
        want = {}
        for u, _, _, v in everything:
            want[u] = (want.get(u, (0, 0))[0] + v, want.get(u, (0, 0))[1] + 1)
        assert {r["user_id"]: (r["total"], r["n"]) for r in got.select("user_id", "total", "n").collect()} == want
        assert jobs.upserted(total, ("user_id",), folder).count() == len(want)  # a rerun changes nothing
    sizes = [spark.read.parquet(f"{folder}/out/batch={n}").count() for n in range(3)]
    assert sizes == [3, 1, 3]
