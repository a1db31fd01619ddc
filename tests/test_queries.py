"""Every query of the library against its SQL."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

from strata import catalog
from strata.plans.session import ship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value without what differs between the engines' Python types; integers stay integers."""
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, wanted = query(spark, sf), con.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    rows = lambda data, columns: sorted(repr([(c, plain(v)) for c, v in sorted(zip(columns, r))]) for r in data)
    assert rows(found.collect(), found.columns) == rows(wanted.fetchall(), names)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, sf, name):
    ship(spark)
    same(spark, sf, catalog.queries()[name], catalog.oracles()[name])
