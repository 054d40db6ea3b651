"""Every registered volume query against its SQL form in DuckDB."""

import math

import duckdb
import pytest

from volumetra.plans import queries as q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    rows = [tuple(plain(v) for v in r) for r in got.select(*sorted(got.columns)).collect()]
    assert rows or name == "list_intersection"
    if name in q.ORACLES:
        want = con.sql(q.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        want = [tuple(plain(v) for v in r) for r in want.select(*(f'"{c}"' for c in sorted(want.columns))).fetchall()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
