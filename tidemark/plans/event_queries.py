"""Time-series, event-study, portfolio and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import events as ev
from ..operators import portfolio as pf
from ..operators import stats
from ..operators import timeseries as ts
from .registry import Registry, Tables, rounded

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

_SIGNUPS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'"
_BUYS = "SELECT user_id, ts, value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL"


def _signups(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").select("event_id", "user_id", "ts")


def _buys(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase' and value is not null").select("user_id", "ts", "value")


@_R.query(f"SELECT s.event_id, s.user_id, b.ts AS obs_at, b.value FROM ({_SIGNUPS}) s ASOF LEFT JOIN ({_BUYS}) b ON s.user_id = b.user_id AND s.ts <= b.ts")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return ts.asof_forward(_signups(t), _buys(t), "user_id", "ts", ["value"]).drop("ts")


@_R.query(f"SELECT s.event_id, s.user_id, b.ts AS obs_at, b.value FROM ({_SIGNUPS}) s ASOF LEFT JOIN ({_BUYS}) b ON s.user_id = b.user_id AND s.ts >= b.ts")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return ts.asof_backward(_signups(t), _buys(t), "user_id", "ts", ["value"]).drop("ts")


@_R.query(f"""
    WITH s AS (SELECT event_id, user_id, ts::DATE AS day FROM ({_SIGNUPS})), b AS (SELECT user_id, ts::DATE AS day, max(value) AS value FROM ({_BUYS}) GROUP BY 1, 2),
    x AS (SELECT s.*, p.value AS a FROM s ASOF LEFT JOIN b p ON s.user_id = p.user_id AND s.day >= p.day),
    y AS (SELECT x.*, CASE WHEN q.day <= x.day + 4 AND a IS NOT NULL THEN q.value END AS z FROM x ASOF LEFT JOIN b q ON x.user_id = q.user_id AND x.day < q.day)
    SELECT event_id, user_id, day, CASE WHEN z IS NOT NULL THEN a END AS pre, z AS post, round(z - a, 6) AS revision, round(CASE WHEN abs(a) > 0.01 THEN (z - a) / abs(a) END, 6) AS revision_pct FROM y
""", dates=("day",))
def bracket_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    signups = _signups(t).select("event_id", "user_id", F.to_date("ts").alias("day"))
    buys = _buys(t).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))
    return rounded(ev.bracket_revision(signups, buys, "user_id", "day", "value", window_days=4))


@_R.query(f"""
    SELECT user_id, ts, value, lead(ts, 10) OVER w AS ts_n, lead(value, 10) OVER w AS value_n FROM ({_BUYS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts)
""")
def nth_following_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.nth_following(_buys(Tables(spark, sf_dir)), "user_id", "ts", "value", 10)


_DAILY = "SELECT user_id, ts::DATE AS day, max(value) AS value FROM events GROUP BY 1, 2"


def _daily(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("value"))


@_R.query(f"""
    WITH d AS ({_DAILY}), l AS (SELECT user_id, day AS t0, value AS p0, lead(day, 10) OVER w AS t1, lead(value, 10) OVER w AS p1 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    e AS (SELECT event_id, user_id, ts::DATE AS day FROM ({_SIGNUPS})),
    h AS (SELECT e.*, l.t0, l.p0, l.t1, l.p1 FROM e ASOF JOIN l ON e.user_id = l.user_id AND e.day <= l.t0),
    b AS (SELECT day, avg(value) AS value FROM d GROUP BY 1)
    SELECT event_id, user_id, h.day, t0, t1, round(p1 / p0 - 1, 6) AS stock_return, round(arg_max(b.value, b.day) / arg_min(b.value, b.day) - 1, 6) AS benchmark_return,
           round(p1 / p0 - arg_max(b.value, b.day) / arg_min(b.value, b.day), 6) AS abnormal_return
    FROM h JOIN b ON b.day BETWEEN t0 AND t1 WHERE t1 IS NOT NULL GROUP BY event_id, user_id, h.day, t0, t1, p0, p1 HAVING count(*) >= 2
""", dates=("day", "t0", "t1",))
def abnormal_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    daily = _daily(t)
    signups = _signups(t).select("event_id", "user_id", F.to_date("ts").alias("day"))
    index = daily.groupBy("day").agg(F.avg("value").alias("value"))
    return rounded(ev.abnormal_return(signups, daily, index, "user_id", "day", "value", 10))


_SPINE = f"""WITH d AS ({_DAILY}), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1), g AS (SELECT * FROM s LEFT JOIN d USING (user_id, day))"""


def _grid(t: Tables) -> DataFrame:
    daily = _daily(t)
    span = daily.groupBy("user_id").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(daily, ["user_id", "day"], "left")


@_R.query(f"{_SPINE} SELECT user_id, day, round(value / lag(value) OVER (PARTITION BY user_id ORDER BY day) - 1, 6) AS change FROM g", dates=("day",))
def pct_change_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(Tables(spark, sf_dir)).select("user_id", "day", scalars.nearest(ts.pct_change("value", "user_id", "day"), 6).alias("change"))


@_R.query(f"""{_SPINE}, f AS (SELECT user_id, day, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day) AS v FROM g)
    SELECT user_id, day, round(v / lag(v) OVER (PARTITION BY user_id ORDER BY day) - 1, 6) AS change FROM f""", dates=("day",))
def ffill_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(Tables(spark, sf_dir)).select("user_id", "day", scalars.nearest(ts.pct_change("value", "user_id", "day", fill=True), 6).alias("change"))


@_R.query("""
    WITH m AS (SELECT o_custkey, last_day(o_orderdate) AS month, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS price FROM orders GROUP BY 1, 2),
    s AS (SELECT o_custkey, last_day(unnest(generate_series(date_trunc('month', min(month)), max(month)::TIMESTAMP, INTERVAL 1 MONTH))) AS month FROM m GROUP BY 1)
    SELECT o_custkey, month, price FROM s LEFT JOIN m USING (o_custkey, month)
""", dates=("month",))
def month_end_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"))
    return ts.month_end_last(orders, "o_custkey", "day", "price", "o_orderkey")


@_R.query("""
    WITH o AS (SELECT l_suppkey AS k, l_shipdate::DATE AS day, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), y AS (SELECT DISTINCT year(day) AS year FROM o),
    g AS (SELECT k, year, make_date(year, 12, 31) AS ye FROM (SELECT DISTINCT k FROM o), y)
    SELECT g.k AS l_suppkey, g.year, round(arg_max(p, day) / arg_min(p, day) FILTER (WHERE day >= ye - 380) - 1, 6) AS trailing_return
    FROM g JOIN o ON o.k = g.k AND o.day <= ye GROUP BY g.k, g.year, ye HAVING count(*) >= 200 AND count(*) FILTER (WHERE day >= ye - 380) > 0
""")
def trailing_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("p"))
    return rounded(ts.trailing_return(daily, "l_suppkey", "day", "p", F.year("day")))


@_R.query("""
    WITH d AS (SELECT l_suppkey, l_shipdate::DATE AS day, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT l_suppkey, year(day) AS year, p / lag(p) OVER (PARTITION BY l_suppkey ORDER BY day) - 1 AS r FROM d)
    SELECT l_suppkey, year, count(*) AS n_obs, round(stddev_samp(r) * sqrt(252), 6) AS volatility FROM r WHERE r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50
""")
def annual_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(F.avg("l_extendedprice").alias("p"))
    return rounded(ts.volatility(daily, "l_suppkey", "day", "p"))


@_R.query("SELECT o_orderkey, last_day((date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE) AS entry_month FROM orders", dates=("entry_month",))
def entry_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", scalars.entry_month(F.to_date("o_orderdate")).alias("entry_month"))


@_R.query("""
    WITH e AS (SELECT c_nationkey, quantile_cont(c_acctbal, [0.0, 1/3.0, 2/3.0, 1.0]) AS e FROM customer GROUP BY 1)
    SELECT c_custkey, c_nationkey, (c_acctbal > e[2])::INT + (c_acctbal > e[3])::INT AS bucket FROM customer JOIN e USING (c_nationkey) WHERE len(list_distinct(e)) = 4
""")
def qcut_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.qcut(Tables(spark, sf_dir).customer, ["c_nationkey"], "c_acctbal", 3).select("c_custkey", "c_nationkey", "bucket")


_FIRST, _LAST = "1995-01-31", "2001-11-30"
#: Events are returned items, names are suppliers: scored by price, sized by quantity.
_EVENTS = "SELECT l_orderkey, l_suppkey AS k, l_extendedprice AS score, l_quantity AS size, l_discount AS discount, l_shipdate::DATE AS filed, last_day((date_trunc('month', l_shipdate) + INTERVAL 1 MONTH)::DATE) AS entry FROM lineitem WHERE l_returnflag = 'R'"
_MONTHS = "m AS (SELECT last_day(unnest(generate_series(DATE '1995-01-01', DATE '2001-11-01', INTERVAL 1 MONTH))) AS month)"


def _active_sql(holding: int, name: str = "act") -> str:
    return f"{name} AS (SELECT ev.*, month FROM ev JOIN m ON entry > month - INTERVAL {holding} MONTH AND entry <= month)"


_ACTIVE = f"{_MONTHS}, ev AS ({_EVENTS}), {_active_sql(3)}"
_MONTHLY = "ret AS (SELECT k, month, p / lag(p) OVER (PARTITION BY k ORDER BY month) - 1 AS ret FROM (SELECT l_suppkey AS k, last_day(l_shipdate) AS month, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2))"
_ORDER = ["filed", "l_orderkey", "score", "size"]
_ORDER_SQL = ", ".join(f"{c} DESC" for c in _ORDER)


def _spread_sql(n: int, least: int, extra: str = "", source: str = "act", tag: str = "") -> str:
    e = f"{extra}, " if extra else ""
    p = f"PARTITION BY {e}month"
    edges = ", ".join(f"{i}/{n}.0" for i in range(n + 1))
    bucket = " + ".join(f"(score > e[{i + 1}])::INT" for i in range(1, n))
    return f"""c{tag} AS (SELECT *, count(*) OVER ({p}) AS cnt FROM {source}),
        s{tag} AS (SELECT * FROM c{tag} WHERE cnt >= {least * n} QUALIFY row_number() OVER (PARTITION BY {e}month, k ORDER BY {_ORDER_SQL}) = 1),
        q{tag} AS (SELECT {e}month, quantile_cont(score, [{edges}]) AS e FROM s{tag} GROUP BY ALL),
        g{tag} AS (SELECT s{tag}.*, {bucket} AS b FROM s{tag} JOIN q{tag} USING ({e}month) WHERE len(list_distinct(e)) = {n + 1}),
        sp{tag} AS (SELECT {e}g{tag}.month, count(*) AS n_active, avg(ret) FILTER (WHERE b = {n - 1}) AS high, avg(ret) FILTER (WHERE b = 0) AS low FROM g{tag} LEFT JOIN ret ON ret.k = g{tag}.k AND ret.month = g{tag}.month GROUP BY ALL)"""


def _hac_sql(source: str) -> str:
    """Mean, HAC error, t and p of ``s`` by ``month``; p by the trapezoid rule over the normal density."""
    return f"""(WITH u AS (SELECT month, s, s - avg(s) OVER () AS u FROM ({source})),
        l AS (SELECT s, u, lag(u, 1) OVER w AS l1, lag(u, 2) OVER w AS l2, lag(u, 3) OVER w AS l3 FROM u WINDOW w AS (ORDER BY month)),
        a AS (SELECT count(*) AS n, avg(s) AS mean, sqrt(sum(u*u) + 1.5 * coalesce(sum(u*l1), 0) + coalesce(sum(u*l2), 0) + 0.5 * coalesce(sum(u*l3), 0)) / count(*) AS se FROM l)
        SELECT n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 6) AS t, round({_normal_p("mean / se")}, 5) AS p, round(pow(1 + mean, 12) - 1, 4) AS annualized FROM a)"""


def _trapezoid(density: str, top: str, steps: int = 20000) -> str:
    """The integral of ``density``, in ``x``, from 0 to ``top``."""
    return f"list_sum(list_transform(generate_series(0, {steps}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 0.5 ELSE 1.0 END) * list_transform([i * ({top}) / {steps}.0], lambda x: {density})[1])) * ({top}) / {steps}.0"


def _normal_p(z: str) -> str:
    return f"(1 - 2 * {_trapezoid('exp(-x * x / 2) / sqrt(2 * pi())', f'abs({z})')})"


def _t_p(t: str, df: str) -> str:
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * {_trapezoid(f'pow(1 + x * x / ({df}), -(({df}) + 1) / 2.0)', f'abs({t})')})"


def _chi2_p(x: str, df: str) -> str:
    # with x = u * u the density has no pole at 0 from two degrees of freedom on
    return f"(1 - 2 / (pow(2, ({df}) / 2.0) * exp(lgamma(({df}) / 2.0))) * {_trapezoid(f'pow(x, ({df}) - 1) * exp(-x * x / 2)', f'sqrt({x})')})"


def _returned(t: Tables) -> DataFrame:
    day = F.to_date("l_shipdate")
    return t.lineitem.where("l_returnflag = 'R'").select(
        "l_orderkey", F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("size"), F.col("l_discount").alias("discount"),
        day.alias("filed"), scalars.entry_month(day).alias("entry"),
    )


def _positions(t: Tables, holding: int) -> DataFrame:
    return pf.active_positions(_returned(t), "entry", holding, _FIRST, _LAST)


def _latest(t: Tables) -> DataFrame:
    return pf.latest_events(_returned(t), ["k", "entry"], _ORDER)


def _returns(t: Tables) -> DataFrame:
    monthly = t.lineitem.groupBy(F.col("l_suppkey").alias("k"), F.last_day(F.to_date("l_shipdate")).alias("month")).agg(F.avg("l_extendedprice").alias("p"))
    return monthly.select("k", "month", ts.pct_change("p", "k", "month").alias("ret"))


def _spreads(t: Tables, holding: int = 3, n: int = 3) -> DataFrame:
    return pf.monthly_spread(pf.active_positions(_latest(t), "entry", holding, _FIRST, _LAST), _returns(t), "k", "score", n, 3, _ORDER, weight="weight")


@_R.query(f"WITH {_ACTIVE} SELECT l_orderkey, k, score, month FROM act", dates=("month",))
def active_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(Tables(spark, sf_dir), 3).select("l_orderkey", "k", "score", "month")


@_R.query(f"WITH {_ACTIVE}, {_MONTHLY}, {_spread_sql(3, 3)} SELECT month, n_active, round(high, 6) AS high, round(low, 6) AS low, round(high - low, 6) AS spread FROM sp WHERE high IS NOT NULL AND low IS NOT NULL", dates=("month",))
def long_short_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_spreads(Tables(spark, sf_dir)))


_HOLDINGS, _GROUPS = (3, 6, 12), (2, 3, 4, 5)


def _grid_sql() -> str:
    cases = [(h, n) for h in _HOLDINGS for n in _GROUPS]
    ctes = [_active_sql(h, f"act{h}") for h in _HOLDINGS] + [_spread_sql(n, 3, source=f"act{h}", tag=f"_{h}_{n}") for h, n in cases]
    rows = [f"SELECT {h} AS holding, {n} AS groups, * FROM {_hac_sql(f'SELECT month, high - low AS s FROM sp_{h}_{n} WHERE high IS NOT NULL AND low IS NOT NULL')}" for h, n in cases]
    return f"WITH {_MONTHS}, ev AS ({_EVENTS}), {_MONTHLY}, {', '.join(ctes)} {' UNION ALL '.join(rows)}"


@_R.query(_grid_sql())
def long_short_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    events = _latest(t).withColumn("holding", F.explode(F.array(*map(F.lit, _HOLDINGS))))
    positions = pf.active_positions(events, "entry", F.col("holding"), _FIRST, _LAST)
    spreads = pf.grid_spread(positions, _returns(t), "k", "score", _GROUPS, 3, _ORDER, ["holding"], "weight")
    return _hac_rounded(pf.hac_mean(spreads, "spread", "month", ["holding", "groups"]))


def _hac_rounded(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("annualized", F.round("annualized", 4)).withColumn("p", F.round("p", 5)))


@_R.query(f"""WITH {_ACTIVE}, {_MONTHLY}, sl AS (SELECT quantile_cont(size, [0, 0.5, 1]) AS z FROM ev),
    cut AS (SELECT act.*, i AS slice FROM act, sl, (SELECT unnest([0, 1]) AS i) WHERE size BETWEEN z[i + 1] AND z[i + 2]), {_spread_sql(3, 2, "slice", "cut")},
    k AS (SELECT slice, month, high - low AS s, count(*) OVER (PARTITION BY slice) AS m FROM sp WHERE high IS NOT NULL AND low IS NOT NULL)
    SELECT month, round(avg(s), 6) AS spread, count(*) AS n_slices FROM k WHERE m > 5 GROUP BY month""", dates=("month",))
def size_neutral_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(pf.size_neutral_spread(_returned(t), _positions(t, 3), _returns(t), "k", "score", "size", 3, order=_ORDER))


@_R.query(f"""WITH {_ACTIVE}, {_MONTHLY},
    c AS (SELECT *, count(*) OVER (PARTITION BY month) AS cnt FROM act), f AS (SELECT * FROM c WHERE cnt >= 9 QUALIFY row_number() OVER (PARTITION BY month, k ORDER BY {_ORDER_SQL}) = 1),
    r AS (SELECT f.*, ret.ret FROM f JOIN ret ON ret.k = f.k AND ret.month = f.month WHERE ret.ret IS NOT NULL QUALIFY count(*) OVER (PARTITION BY f.month) >= 8),
    a AS (SELECT month, avg(ret) AS my, avg(size) AS m1, avg(discount) AS m2, var_pop(size) AS s11, var_pop(discount) AS s22, covar_pop(size, discount) AS s12, covar_pop(size, ret) AS s1y, covar_pop(discount, ret) AS s2y FROM r GROUP BY month),
    b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM a),
    e AS (SELECT r.month, score, ret - my - b1 * (size - m1) - b2 * (discount - m2) AS residual FROM r JOIN b USING (month)),
    q AS (SELECT month, quantile_cont(score, [0, 1/3.0, 2/3.0, 1]) AS z FROM e GROUP BY month)
    SELECT month, count(*) AS n_active, round(avg(residual) FILTER (WHERE score > z[3]), 6) AS high, round(avg(residual) FILTER (WHERE score <= z[2]), 6) AS low,
           round(avg(residual) FILTER (WHERE score > z[3]) - avg(residual) FILTER (WHERE score <= z[2]), 6) AS spread
    FROM e JOIN q USING (month) WHERE len(list_distinct(z)) = 4 GROUP BY month""", dates=("month",))
def characteristic_adjusted_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(pf.characteristic_adjusted_spread(_positions(t, 3), _returns(t), "k", "score", ["size", "discount"], min_names=8, order=_ORDER))


@_R.query(f"WITH {_ACTIVE}, {_MONTHLY}, {_spread_sql(3, 3)} SELECT * FROM {_hac_sql('SELECT month, high - low AS s FROM sp WHERE high IS NOT NULL AND low IS NOT NULL')}")
def hac_mean_tstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hac_rounded(pf.hac_mean(_spreads(Tables(spark, sf_dir)), "spread", "month"))


@_R.query(f"""WITH {_ACTIVE}, {_MONTHLY}, {_spread_sql(2, 3, tag="2")}, {_spread_sql(3, 3, tag="3")}, {_spread_sql(5, 3, tag="5")},
    a AS (SELECT month, high - low AS s, 'two' AS n FROM sp2 UNION ALL SELECT month, high - low, 'three' FROM sp3 UNION ALL SELECT month, high - low, 'five' FROM sp5)
    SELECT month, round(max(s) FILTER (WHERE n = 'two'), 6) AS two, round(max(s) FILTER (WHERE n = 'three'), 6) AS three, round(max(s) FILTER (WHERE n = 'five'), 6) AS five FROM a WHERE s IS NOT NULL GROUP BY month""", dates=("month",))
def spreads_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    spreads = pf.grid_spread(pf.active_positions(_latest(t), "entry", 3, _FIRST, _LAST), _returns(t), "k", "score", (2, 3, 5), 3, _ORDER, weight="weight")
    return rounded(pf.concat_on([spreads.where(F.col("groups") == n) for n in (2, 3, 5)], "month", ["two", "three", "five"], "spread"))


@_R.query(f"""
    WITH d AS (SELECT c_custkey, c_acctbal AS x, sum(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d)
    SELECT n, round(a, 6) AS pearson, round(b, 6) AS spearman, round({_t_p("a * sqrt((n - 2) / (1 - a * a))", "n - 2")}, 5) AS pearson_p, round({_t_p("b * sqrt((n - 2) / (1 - b * b))", "n - 2")}, 5) AS spearman_p
    FROM (SELECT count(*) AS n, corr(x, y) AS a, corr(rx, ry) AS b FROM r)
""")
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    totals = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("y"))
    d = t.customer.join(totals, "c_custkey").select(F.col("c_acctbal").alias("x"), "y")
    named = lambda df, name: df.select("n", F.col("r").alias(name), F.round("p", 5).alias(f"{name}_p"))
    return rounded(named(stats.pearson(d, "x", "y"), "pearson").join(named(stats.spearman(d, "x", "y"), "spearman"), "n"))


_RANKED = "d AS (SELECT n_chars AS v, quality AS g FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM d)"


@_R.query(f"""
    WITH {_RANKED}, t AS (SELECT sum(c*c*c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM d GROUP BY v)),
    s AS (SELECT count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0, sum(k) FILTER (WHERE g = 1) AS r1 FROM r),
    x AS (SELECT n1, n0, r1 - n1 * (n1 + 1) / 2.0 AS u, n1 * n0 / 2.0 AS m, n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))) AS v FROM s, t)
    SELECT n1, n0, u, round(z, 6) AS z, round({_normal_p("z")}, 5) AS p, round(0.5 - 0.5 * sign(y) * (1 - {_normal_p("y")}), 5) AS p_greater
    FROM (SELECT *, sign(u - m) * greatest(abs(u - m) - 0.5, 0) / sqrt(v) AS z, (u - m - 0.5) / sqrt(v) AS y FROM x)
""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id").select("n_chars", "quality")
    greater = stats.mann_whitney(rows, "n_chars", "quality", "greater").select("n1", "n0", "u", F.round("p", 5).alias("p_greater"))
    return rounded(stats.mann_whitney(rows, "n_chars", "quality").withColumn("p", F.round("p", 5)).join(greater, ["n1", "n0", "u"]))


@_R.query(f"""
    WITH d AS (SELECT n_chars AS v, lang AS g FROM documents), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM d),
    t AS (SELECT sum(c*c*c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM d GROUP BY v)), p AS (SELECT g, count(*) AS c, sum(k) AS s FROM r GROUP BY g),
    a AS (SELECT count(*) AS k, sum(c)::BIGINT AS n, sum(s * s / c) AS q FROM p)
    SELECT k, n, round(h, 6) AS h, round({_chi2_p("h", "k - 1")}, 5) AS p FROM (SELECT k, n, (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM a, t)
""")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kruskal(Tables(spark, sf_dir).documents.select("n_chars", "lang"), "n_chars", "lang")).withColumn("p", F.round("p", 5))


_TERMS = "term string, coef double, se double, z double, p double, n long, clusters long"


def _terms(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return rounded(spark.createDataFrame([(r["term"], r["coef"], r["se"], r["z"], r["p"], r["n"], r.get("clusters")) for r in rows], _TERMS))


def _ordered(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_custkey", (F.col("o_totalprice") / 1e5).alias("y"), (F.col("c_acctbal") / 1e3).alias("x"), F.year("o_orderdate").cast("double").alias("year"), F.month("o_orderdate").cast("double").alias("month"))


@_R.query("""
    WITH d AS (SELECT o_custkey AS g, o_totalprice / 1e5 AS y, c_acctbal / 1e3 AS x FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, avg(x) AS mx, count(*) AS n, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM d),
    u AS (SELECT g, sum((x - mx) * (y - b0 - b1 * x)) AS s FROM d, b GROUP BY g), m AS (SELECT sum(s * s) AS meat, count(*) AS k FROM u)
    SELECT n, k AS clusters, round(b1, 6) AS coef, round(sqrt(meat / (sxx * sxx) * (k / (k - 1.0)) * ((n - 1.0) / (n - 2.0))), 6) AS se FROM b, m
""")
def clustered_ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.ols(_ordered(Tables(spark, sf_dir)), "y", ["x"], "o_custkey")
    return _terms(spark, [r for r in rows if r["term"] == "x"]).select("n", "clusters", "coef", "se")


@_R.query()
def clustered_ols_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, stats.ols(_ordered(Tables(spark, sf_dir)), "y", ["x", "year", "month"], "o_custkey"))


@_R.query()
def two_way_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Tables(spark, sf_dir).lineitem
    panel = items.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("x"))
    found = stats.two_way_fe(panel, "y", ["x"], "l_suppkey", "year")
    return _terms(spark, found["terms"]).withColumn("degenerate", F.lit(found["degenerate"]))


@_R.query()
def two_way_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and month effects against none: within R2 and the test of poolability."""
    items = Tables(spark, sf_dir).lineitem
    panel = items.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("x"), F.avg("l_quantity").alias("w"))
    r = stats.two_way_fe(panel, "y", ["x", "w"], "l_suppkey", "month")
    of = lambda terms: next(({"coef": t["coef"], "p": t["p"]} for t in terms if t["term"] == "x"), {"coef": None, "p": None})
    row = (r["entities"], r["periods"], r["df_num"], r["df_den"], of(r["pooled"])["coef"], of(r["pooled"])["p"], of(r["terms"])["coef"], of(r["terms"])["p"], r["r2_within"], r["f_pooled"], r["poolability_p"])
    kind = "entities long, periods long, df_num long, df_den long, pooled_coef double, pooled_p double, fe_coef double, fe_p double, r2_within double, f_pooled double, poolability_p double"
    return rounded(spark.createDataFrame([row], kind))


@_R.query()
def logit_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select("source", "quality", F.log1p("n_chars").alias("size"), (F.col("lang") == "en").cast("double").alias("english"))
    return _terms(spark, stats.logit(d, "quality", ["size", "english"], cluster="source"))


@_R.query("""
    WITH d AS (SELECT n_nationkey, (n_regionkey = 0)::INTEGER AS g, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY v) AS k FROM d),
    s AS (SELECT count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0, sum(k) FILTER (WHERE g = 1)::BIGINT AS r1 FROM r),
    c AS (SELECT a.k + b.k + c.k + d.k + e.k AS r1 FROM r a JOIN r b ON a.k < b.k JOIN r c ON b.k < c.k JOIN r d ON c.k < d.k JOIN r e ON d.k < e.k),
    t AS (SELECT count(*) FILTER (WHERE c.r1 <= s.r1) / count(*) AS low, count(*) FILTER (WHERE c.r1 >= s.r1) / count(*) AS high FROM c, s)
    SELECT n1, n0, r1 - n1 * (n1 + 1) / 2.0 AS u, round(least(1, 2 * least(low, high)), 8) AS p, round(low, 8) AS p_less, round(high, 8) AS p_greater FROM s, t
""")
def mann_whitney_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean balances of one region's nations, five, against the others': the exact distribution. The SQL
    counts all choices of five of the nations."""
    t = Tables(spark, sf_dir)
    means = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", (F.col("n_regionkey") == 0).cast("int").alias("g")).agg(F.avg("c_acctbal").alias("v"))
    found = [stats.mann_whitney(means, "v", "g", side).select("n1", "n0", "u", F.round("p", 8).alias(name)) for name, side in (("p", "two-sided"), ("p_less", "less"), ("p_greater", "greater"))]
    return found[0].join(found[1], ["n1", "n0", "u"]).join(found[2], ["n1", "n0", "u"])


@_R.query()
def logit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    d = t.documents.join(t.labels, "doc_id").select("quality", F.log1p("n_chars").alias("size"), (F.col("lang") == "en").cast("double").alias("english"))
    return _terms(spark, stats.logit(d, "quality", ["size", "english"]))


@_R.query()
def test_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ordered(Tables(spark, sf_dir))
    found = stats.battery(rows, "all", "y", "x", "o_custkey", ["year", "month"]) + stats.battery(rows.where("year < 0"), "none", "y", "x", "o_custkey")
    kind = "label string, test string, n long, clusters long, stat double, p_value double, note string"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in found], kind)


@_R.query("""
    WITH q AS (SELECT quantile_cont(o_totalprice, [0.01, 0.99]) AS w, quantile_cont(o_totalprice, [0.1, 0.9]) AS e FROM orders)
    SELECT o_orderkey, round(greatest(least(o_totalprice, w[2]), w[1]), 6) AS clipped, o_totalprice <= e[1] OR o_totalprice >= e[2] AS extreme FROM orders, q
""")
def winsorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("clipped"))
    return rounded(stats.extreme_tail(stats.winsorize(orders, "clipped"), "o_totalprice").select("o_orderkey", "clipped", "extreme"))


@_R.query("SELECT event_type, round(regr_slope(value, epoch(ts::DATE) / 86400), 6) AS slope, round(regr_intercept(value, epoch(ts::DATE) / 86400 - 19723), 6) AS intercept FROM events GROUP BY 1")
def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.unix_date(F.to_date("ts")) - 19723).cast("double")
    events = Tables(spark, sf_dir).events.select("event_type", "value", day.alias("x"))
    return rounded(events.groupBy("event_type").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept")))
