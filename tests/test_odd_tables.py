"""Queries against their SQL on tables with zeros, nulls and prices of many digits."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import stats
from tidemark.plans import catalog

from test_queries import plain


def compare(spark, folder, name):
    df = catalog.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    con = duckdb.connect()
    for f in folder.iterdir():
        con.sql(f"create view {f.stem} as from '{f}'")
    want = con.sql(catalog.oracle_sql()[name])
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    return got


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory, sf_dir):
    """Two months of eight users: values of 0 and null, a day without any, null users and times."""
    folder = tmp_path_factory.mktemp("events")
    duckdb.sql(f"""copy (select event_id, case when event_id % 97 = 3 then null else ts end as ts, case when event_id % 41 = 3 then null else user_id % 8 end as user_id, event_type, props,
        case when event_id % 5 < 2 then 0.0 when event_id % 11 = 0 or ts::date = date '2024-01-09' then null else value end as value from '{sf_dir}/events.parquet') to '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", ["abnormal_return", "ffill_pct_change", "pct_change_daily"])
def test_returns_from_zero_and_without_a_price(spark, odd_events, name):
    got = compare(spark, odd_events, name)
    assert any("inf" in row for row in got) and any(None in row for row in got)


@pytest.mark.parametrize("name", ["pct_change_daily", "ffill_pct_change"])
def test_changes_halfway_between_two_roundings(spark, tmp_path, name):
    """9.73 / 6.4 - 1 is just under 0.5203125 times a million, though its shortest text is that number."""
    prices = [(6.4, 3.17), (6.4, 9.63), (6.4, 9.73), (6.4, 12.81), (6.4, 19.27), (1.28, 1.29)]
    rows = ", ".join(f"({u}, timestamp '2024-01-0{d + 1}', {p}::double)" for u, pair in enumerate(prices) for d, p in enumerate(pair))
    duckdb.sql(f"copy (select * from (values {rows}) t(user_id, ts, value)) to '{tmp_path}/events.parquet'")
    got = {(r["user_id"], r["change"]) for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view events as from '{tmp_path}/events.parquet'")
    assert got == set(con.sql(f"select user_id, change from ({catalog.oracle_sql()[name]})").fetchall())


def test_ranks_of_values_that_differ_when_summed_anew(spark):
    """The last bits of a sum follow the order of its rows; no row may be lost between ranks and values."""
    near = F.udf(lambda v: v * (1 + random.choice((0, 1, 2)) * 2.0**-52), "double").asNondeterministic()
    df = spark.range(500).select((F.col("id") * 7 % 499).cast("double").alias("x"), near(F.col("id") * 0.1 + 1).alias("y"), (F.col("id") % 2).alias("g"))
    assert stats.spearman(df, "x", "y").first()["n"] == 500
    assert sum(stats.mann_whitney(df, "y", "g").first()[c] for c in ("n1", "n0")) == 500
    assert stats.kruskal(df, "y", "g").first()["n"] == 500
    assert stats.average_ranks(df, "y").count() == 500


def test_texts_are_folded_once(spark):
    """A text is folded once for all keywords, and plain characters are told by one look."""
    df = spark.createDataFrame([(1, "Ünïcode ½ licensed ﬁn. \U0001f600한글"), (2, None)], "i int, t string")
    both = df.select("i", scalars.keyword_score(F.col("t"), ("ing", "fin", "1⁄2", "uni")).alias("a"), scalars.contains_any(F.col("t"), ("none", "licens")).alias("b"))
    assert [tuple(r) for r in both.orderBy("i").collect()] == [(1, 3, True), (2, 0, False)]
    assert both._jdf.queryExecution().analyzed().toString().count("translate(") == 2
    assert len(re.findall(r"\[\\x", scalars._class(range(0x300, 0x3000, 2)))) > 100
