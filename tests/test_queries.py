"""Every registered query of the engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from prosestruct.plans.oracle import ORACLE
from prosestruct.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def shown(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else round(value, 9) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want
