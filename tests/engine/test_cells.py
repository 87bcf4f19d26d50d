"""The join by cells: the same rows for any dealing, and an asker once for each group of its cells."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tidewire.operators import vectors

N, CELLS, HOUR = 400, 12, 3600 * 1_000_000


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 6)).astype(np.float32)
    at, cell = rng.integers(0, 20, N) * 6 * HOUR, rng.integers(0, CELLS, N)
    asks = [sorted(rng.permutation(CELLS)[: rng.integers(1, CELLS)].tolist()) for _ in range(N)]
    rows = [(i, int(at[i]), x[i].tolist(), int(cell[i]), asks[i]) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, at long, embedding array<float>, cell int, cells array<int>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = set()
    for i in range(N):
        there = [j for j in range(N) if j != i and cell[j] in asks[i] and abs(at[i] - at[j]) <= 24 * HOUR]
        want |= {(i, j) for _, j in sorted((round(1 - float(unit[i] @ unit[j]), 6), j) for j in there)[:3]}
    return df.drop("cells"), df.select(F.col("id").alias("q_id"), "at", F.col("embedding").alias("vector"), "cells"), want


@pytest.mark.parametrize(("block", "groups"), [(65_536, 8), (65_536, 1), (7, 5), (7, CELLS)])
def test_same_as_one_by_one(made, block, groups):
    stored, asked, want = made
    assert {(r["q_id"], r["id"]) for r in vectors.in_cells(stored, asked, 3, True, 24, block, groups).collect()} == want


def test_an_asker_goes_once_to_a_group(spark):
    """An asker of 64 cells is shuffled in 8 rows; it was 64."""
    rows = spark.range(640).select("id", F.lit(0).cast("long").alias("at"), F.array(F.sin("id"), F.cos("id")).alias("embedding"), F.expr("CAST(id % 64 AS INT)").alias("cell"))
    asked = rows.select(F.col("id").alias("q_id"), "at", F.col("embedding").alias("vector"), F.sequence(F.lit(0), F.lit(63)).alias("cells"))
    seen = Observation()
    real = DataFrame.mapInArrow
    try:
        DataFrame.mapInArrow = lambda df, *args: real(df.observe(seen, F.count("*").alias("n")), *args)
        assert vectors.in_cells(rows, asked, 1, False).count() == 640
    finally:
        DataFrame.mapInArrow = real
    assert seen.get["n"] == 640 + 8 * 640
