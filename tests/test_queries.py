"""Every registered query of the table operators against its SQL, on the smallest tables."""

import os

import pytest

from tabloom import queries as q

duckdb = pytest.importorskip("duckdb")


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or x != x:
            return "~"
        if isinstance(x, (bool,)):
            return str(x)
        if hasattr(x, "isoformat"):
            return x.isoformat()
        try:
            return repr(round(float(x), 6)) if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = q.QUERIES[name](spark, sf_dir)
    out = duck.execute(q.SQL[name])
    columns = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(out.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
