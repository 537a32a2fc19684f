"""Rules over fixed rows against DuckDB: what has no rows of the given tables to run on."""

import duckdb
import pytest

from pagelode.plans import preparation_queries  # noqa: F401  (adds its own)
from pagelode.plans.queries import FIXED, QUERIES


@pytest.mark.parametrize("name", sorted(FIXED))
def test_equal_to_sql(spark, name):
    query, sql = FIXED[name]
    assert name not in QUERIES
    found, told = query(spark, ""), duckdb.connect().sql(sql)
    names = sorted(found.columns)
    assert names == sorted(told.columns)

    def plain(rows, columns):
        one = lambda x: round(float(x), 6) + 0.0 if isinstance(x, float) else x
        return sorted(repr(tuple(one(r[columns.index(c)]) for c in names)) for r in rows)

    assert plain(found.collect(), found.columns) == plain(told.fetchall(), told.columns)
