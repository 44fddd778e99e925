"""Every registered screening query against its SQL counterpart."""

import duckdb
import pytest

from cliploom.plans.oracles import ORACLES
from cliploom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == columns
    theirs = sorted(repr(tuple(plain(r[order.index(c)]) for c in columns)) for r in found.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
