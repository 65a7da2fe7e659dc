"""Every registered query that has SQL gives its rows, on the smallest tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def names():
    from trajekt.plans import queries

    return sorted(queries.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from trajekt.plans import queries

    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got
    if name in queries.oracle_sql():
        cur = con.execute(queries.oracle_sql()[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == cols
        at = [have.index(c) for c in cols]
        assert got == sorted(repr(tuple(plain(r[k]) for k in at)) for r in cur.fetchall())


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
