"""Every registered query against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from tidewire.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda x: round(x, 9) if isinstance(x, float) else x
    return [names[i] for i in order], sorted([tuple(fix(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
