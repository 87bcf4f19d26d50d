"""Hard negatives against all pairs, with odd rows; and against the SQL."""

import math
import random

import duckdb
import pytest

from tidewire.llm import negatives
from tidewire.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, q long, score string, pivot double"


def plain(rows, every):
    """By all pairs; a row is (id, label, whole numbers)."""
    have = set()
    for i, x, label in rows:
        if label is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            v = [math.floor(256 * e) for e in x]
            while v and v[-1] == 0:
                v.pop()  # shorter vectors are filled up with zeros
            have.add((negatives.NO_ID if i is None else i, label, tuple(v)))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    known = lambda i: None if i == negatives.NO_ID else i
    for a in have:
        if a[0] == negatives.NO_ID or a[0] % every:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b) for b in have))
        for s, i, b in [x for x in scored if x[2][1] == a[1] and x[2] != a][:5]:
            near = [x for x in scored if x[2][1] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a[0], known(i), n + 1, known(x[1]), -s, -x[0]) for n, x in enumerate(near[:3])]
    return sorted(out, key=str)


def table(seed, n=160):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.5) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        rows.append((i, [x + r.gauss(0, 0.15) for x in c], r.randrange(3)))
    rows += [(i, rows[3][1], rows[3][2]) for i in range(200, 230)] + [(i, rows[3][1], 1 + rows[3][2]) for i in range(230, 260)]  # copies, two labels
    rows += [rows[0], rows[10], (10, rows[11][1], 1), (None, rows[12][1], 2), (None, None, 1), (5, None, 1), (6, [None, 1.0], 1), (7, [float("nan")], 1), (8, [float("inf"), 0.0], 1), (9, [1.0], None)]
    rows += [(300, [], 0), (310, [0.5, 0.25], 1), (320, [0.0] * 6, 2), (-20, rows[20][1], 0)]
    return [(i, None if x is None else [None if e is None else float(e) for e in x], label) for i, x, label in rows]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block": 4, "pivots": 5, "sample": 40}), (3, {"block": 16, "pivots": 3})])
def test_all_pairs(spark, seed, options, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST", 8 if options else 4096)  # small steps take many rounds
    rows = [(i, x, label) for i, x, label in table(seed)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA).repartition(3)
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]  # floats as Spark holds them
    got = negatives.mine(negatives.quantised(df), every=10, **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(exact, 10)


def test_rings_pass_over_far_blocks(spark):
    """Far groups of vectors aren't scanned."""
    r = random.Random(4)
    rows = [(i, [10.0 * (i % 8 == k) + r.gauss(0, 0.01) for k in range(8)], i % 3) for i in range(800)]
    index = negatives.Index(negatives.reduced(negatives.quantised(spark.createDataFrame([(*x, 1, "x", 2.0) for x in rows], SCHEMA)), 6), block=16, pivots=8)
    near = negatives._bounds(negatives._padded(index.blocks.sparkSession.sql("select array(2560,0,0,0,0,0,0,0) v").toArrow()["v"].chunk(0), 8), index.pivots.value, index.directory.value, index.far)
    assert (near[0][0] < 100).sum() < len(near[0][0]) / 4


def test_empty_and_errors(spark):
    assert negatives.mine(negatives.quantised(spark.createDataFrame([], SCHEMA))).collect() == []
    with pytest.raises(Exception, match="31 bits"):
        negatives.mine(negatives.quantised(spark.createDataFrame([(50, [1e30], 1, 1, "x", 2.0)], SCHEMA)))


def test_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    want = db.execute(f"SELECT {names} FROM ({SQL['op11_hard_negatives']})").fetchall()
    got = QUERIES["op11_hard_negatives"](spark, sf_dir).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
