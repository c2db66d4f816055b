"""Every registered query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from loomery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    got = registry.queries()[name](spark, sf_dir)
    want = oracle.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(map(_plain, r)) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=repr)
