"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
#: Held against NumPy in ``test_statistics`` and ``difflib`` in ``test_diff``.
BRUTE = {"line_diff_sources", "two_way_fit", "logit_clustered", "clustered_ols_controls", "two_way_fe", "logit_group", "test_battery", "specification_comparison", "specification_flips", "panel_battery"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.5g}" if isinstance(v, float) else str(v)


def test_every_query_is_held_against_something():
    assert set(QUERIES) == set(ORACLE) | BRUTE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{sf_dir}/{f}'")
    want = con.sql(ORACLE[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
