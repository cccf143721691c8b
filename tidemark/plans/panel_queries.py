"""Feature builders, predicates and specification tests over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import panels, relational, stats
from .registry import Registry, Tables, rounded

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle

#: Items stand for statement lines: the flag and the number for the account, the status for the basis.
_CODE = "l_returnflag || l_linenumber % 2"
_NAMES = {"A0": "total_assets", "A1": "current_liabilities", "N0": "noncurrent_liabilities", "N1": "total_equity", "R0": "net_revenue", "R1": "net_income"}
_EXTENDED = {**{k: v for k, v in _NAMES.items() if v != "net_revenue"}, "R0": "financial_expense"}
_STATEMENTS = f"""SELECT l_suppkey AS entity, year(l_shipdate) AS fiscal_year, {_CODE} AS code, CASE l_linestatus WHEN 'F' THEN 'con' ELSE 'ind' END AS basis,
    CASE WHEN l_tax > 0.07 THEN 'PENLTIMO' ELSE 'ULTIMO' END AS tag, l_quantity * 100 - 1000 AS value, l_orderkey, l_extendedprice FROM lineitem"""
_ORDER = ["l_orderkey", "l_extendedprice", "value"]


def _statements(t: Tables) -> DataFrame:
    basis = F.when(F.col("l_linestatus") == "F", "con").otherwise("ind")
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("fiscal_year"), F.expr(_CODE).alias("code"), basis.alias("basis"),
        F.when(F.col("l_tax") > 0.07, "PENLTIMO").otherwise("ULTIMO").alias("tag"), (F.col("l_quantity") * 100 - 1000).alias("value"), "l_orderkey", "l_extendedprice",
    )
    return panels.current_period(rows, "tag")


def _wide_sql(names: dict[str, str]) -> str:
    """First values by account and basis through a pivot, the consolidated one preferred."""
    cells = ", ".join(f"coalesce(max(value) FILTER (WHERE code = '{c}' AND basis = 'con'), max(value) FILTER (WHERE code = '{c}' AND basis = 'ind')) AS {n}" for c, n in names.items())
    return f"""st AS ({_STATEMENTS}), cur AS (SELECT * FROM st WHERE contains(tag, 'LTIMO') AND NOT contains(tag, 'PEN') AND code IN ({", ".join(f"'{c}'" for c in names)})),
        fst AS (SELECT * FROM cur QUALIFY row_number() OVER (PARTITION BY entity, fiscal_year, code, basis ORDER BY {", ".join(_ORDER)}) = 1),
        wide AS (SELECT entity, fiscal_year, {cells} FROM fst GROUP BY 1, 2)"""


@_R.query(f"""WITH {_wide_sql(_NAMES)} SELECT *, current_liabilities + noncurrent_liabilities AS total_liabilities, round((current_liabilities + noncurrent_liabilities) / nullif(total_assets, 0), 6) + 0 AS leverage,
    round(net_income / nullif(total_assets, 0), 6) + 0 AS roa, round(net_income / nullif(total_equity, 0), 6) + 0 AS roe, round(CASE WHEN total_assets IS NOT NULL THEN ln(greatest(total_assets, 1)) END, 6) AS ln_total_assets,
    round(CASE WHEN net_revenue IS NOT NULL THEN ln(greatest(net_revenue, 1)) END, 6) AS ln_net_revenue FROM wide WHERE total_assets IS NULL OR total_assets <> 0""")
def control_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = panels.accounts(_statements(Tables(spark, sf_dir)), ["entity", "fiscal_year"], "code", "value", "basis", _ORDER, _NAMES)
    return rounded(panels.control_variables(wide))


_LIABILITIES = "CASE WHEN current_liabilities IS NOT NULL OR noncurrent_liabilities IS NOT NULL THEN coalesce(current_liabilities, 0) + coalesce(noncurrent_liabilities, 0) END"


@_R.query(f"""WITH {_wide_sql(_EXTENDED)}, l AS (SELECT *, {_LIABILITIES} AS total_liabilities FROM wide) SELECT *, round(total_liabilities / nullif(total_assets, 0), 6) + 0 AS leverage, round(net_income / nullif(total_assets, 0), 6) + 0 AS roa,
    round(CASE WHEN total_assets > 0 THEN ln(total_assets) END, 6) AS ln_total_assets, round(abs(financial_expense) / nullif(total_liabilities, 0), 6) AS cost_of_debt FROM l""")
def extended_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = panels.accounts(_statements(Tables(spark, sf_dir)), ["entity", "fiscal_year"], "code", "value", "basis", _ORDER, _EXTENDED)
    return rounded(panels.extended_controls(wide))


@_R.query(f"""
    WITH {_wide_sql({"N1": "total_equity"})}, p AS (SELECT l_suppkey AS entity, l_shipdate::DATE AS day, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
    sh AS (SELECT l_suppkey AS entity, year(l_shipdate) AS year, l_quantity AS common, CASE WHEN l_discount > 0.05 THEN l_quantity * 2 END AS preferred, l_orderkey, l_extendedprice FROM lineitem),
    one AS (SELECT *, common + coalesce(preferred, 0) AS total_shares FROM sh WHERE common + coalesce(preferred, 0) > 0 QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY l_orderkey, l_extendedprice, common) = 1),
    y AS (SELECT DISTINCT year FROM sh), spine AS (SELECT year, (SELECT max(day) FROM p WHERE day <= make_date(y.year, 12, 31)) AS day FROM y)
    SELECT p.entity, spine.year, total_shares, round(price * total_shares, 4) AS market_cap, round(price * total_shares / nullif(total_equity, 0), 6) AS market_to_book
    FROM spine JOIN p USING (day) JOIN one ON one.entity = p.entity AND one.year = spine.year LEFT JOIN wide ON wide.entity = p.entity AND wide.fiscal_year = spine.year
""")
def market_to_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    prices = t.lineitem.groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("day")).agg(F.max("l_extendedprice").alias("price"))
    shares = t.lineitem.select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("common"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity") * 2).alias("preferred"), "l_orderkey", "l_extendedprice"
    )
    equity = panels.accounts(_statements(t), ["entity", "fiscal_year"], "code", "value", "basis", _ORDER, {"N1": "total_equity"}).withColumnRenamed("fiscal_year", "year")
    ends = panels.year_end_prices(prices, shares.select("year").distinct(), "entity", "day", "price")
    found = panels.market_to_book(ends, shares, equity, "entity", "price", ["common", "preferred"], "l_orderkey", "l_extendedprice", "common")
    return found.select("entity", "year", "total_shares", scalars.nearest(F.col("market_cap"), 4).alias("market_cap"), scalars.nearest(F.col("market_to_book"), 6).alias("market_to_book"))


_FILED = "SELECT o_orderkey, o_custkey, date_trunc('month', o_orderdate)::DATE + 30 AS period, o_orderstatus, o_orderkey AS version FROM orders"
_REGISTER = "reg AS (SELECT c_custkey AS o_custkey, c_mktsegment AS sector FROM customer), ok AS (SELECT DISTINCT o_custkey FROM reg WHERE NOT contains(lower(sector), 'machinery') AND NOT contains(lower(sector), 'furniture'))"


def _universe_args(t: Tables) -> dict:
    index = t.orders.select("o_orderkey", "o_custkey", F.date_add(F.trunc("o_orderdate", "MM"), 30).alias("period"), "o_orderstatus", F.col("o_orderkey").alias("version"))
    register = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sector"))
    banks = scalars.contains_any(F.col("sector"), ("machinery", "furniture"))
    return dict(index=index, register=register, entity="o_custkey", period="period", version="version", sector="sector", excluded=banks, chosen=F.col("o_orderstatus") != "P")


@_R.query(f"""WITH {_REGISTER}, i AS ({_FILED}) SELECT i.o_custkey, period, o_orderkey, sector FROM i JOIN ok USING (o_custkey) JOIN reg USING (o_custkey) WHERE o_orderstatus <> 'P'
    QUALIFY row_number() OVER (PARTITION BY i.o_custkey, period ORDER BY version DESC) = 1""", dates=("period",))
def annual_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.universe(**_universe_args(Tables(spark, sf_dir))).select("o_custkey", "period", "o_orderkey", "sector")


@_R.query(f"""WITH {_REGISTER}, i AS ({_FILED}) SELECT i.o_custkey, period, o_orderkey, sector, year(period) || 'Q' || quarter(period) AS quarter FROM i JOIN ok USING (o_custkey) JOIN reg USING (o_custkey)
    WHERE o_orderstatus <> 'P' AND strftime(period, '%m-%d') IN ('03-31', '06-30', '09-30') QUALIFY row_number() OVER (PARTITION BY i.o_custkey, period ORDER BY version DESC) = 1""", dates=("period",))
def quarterly_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.quarterly_universe(**_universe_args(Tables(spark, sf_dir))).select("o_custkey", "period", "o_orderkey", "sector", "quarter")


@_R.query("""
    WITH g AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS f, count(*) AS matched FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2),
    logs AS (SELECT o_orderkey, matched, 'current' AS source FROM g WHERE f = 'N' UNION ALL SELECT o_orderkey, matched, 'historical' FROM g WHERE f = 'A')
    SELECT o_orderkey, matched, source, o_orderdate::DATE AS filing_date, o_custkey FROM logs LEFT JOIN orders USING (o_orderkey)
""", dates=("filing_date",))
def filing_date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(F.count_if(F.col("l_quantity") > 25).alias("matched"))
    logs = {name: counts.where(F.col("l_returnflag") == f).drop("l_returnflag") for name, f in (("current", "N"), ("historical", "A"))}
    index = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("filing_date"), "o_custkey")
    return panels.filing_dates(logs, index, ["o_orderkey"], "matched", "o_orderkey")


_COUNTS = """SELECT l_suppkey AS entity, year(l_shipdate) AS year, l_linestatus AS body, (l_returnflag = 'A')::INT AS women, (l_returnflag = 'N')::INT AS men, (l_returnflag = 'R')::INT AS others,
    (l_quantity > 45)::INT AS black, (l_quantity BETWEEN 30 AND 45)::INT AS brown, (l_quantity < 30)::INT AS white FROM lineitem"""


def _share_sql(name: str, body: str, part: str, whole: str) -> str:
    flag = f"FILTER (WHERE body = '{body}')"
    share = f"sum({part}) {flag} / nullif(sum({whole}) {flag}, 0)::DOUBLE"
    return f"round({share}, 6) AS {name}, coalesce({share} > 0, false) AS has_{name}"


@_R.query(f"""WITH c AS ({_COUNTS}), s AS (SELECT entity, year, {_share_sql("female_board", "F", "women", "women + men + others")}, {_share_sql("female_exec", "O", "women", "women + men + others")},
    {_share_sql("nonwhite_board", "F", "black + brown", "black + brown + white")}, {_share_sql("nonwhite_exec", "O", "black + brown", "black + brown + white")},
    coalesce(sum(women + men + others) FILTER (WHERE body = 'F'), 0) AS board_size, coalesce(sum(women + men + others) FILTER (WHERE body = 'O'), 0) AS exec_size FROM c GROUP BY 1, 2)
    SELECT * FROM s WHERE board_size > 0""")
def composition_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    rows = Tables(spark, sf_dir).lineitem.select(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("body"), flag(f == "A").alias("women"), flag(f == "N").alias("men"), flag(f == "R").alias("others"),
        flag(q > 45).alias("black"), flag(q.between(30, 45)).alias("brown"), flag(q < 30).alias("white"),
    )
    shares = {"female": (["women"], ["women", "men", "others"]), "nonwhite": (["black", "brown"], ["black", "brown", "white"])}
    return rounded(panels.composition_panel(rows, ["entity", "year"], "body", {"board": "F", "exec": "O"}, shares, ("board", "board_size")))


@_R.query("""SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS click, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS view FROM events GROUP BY 1""")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(relational.pivot_mean(Tables(spark, sf_dir).events, ["user_id"], "event_type", "value", ["click", "view"]))


@_R.query("SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'purchase' THEN value END) AS n_valid, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY 1")
def valid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir).events.withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rounded(relational.valid_counts(events, ["user_id"], "paid", F.col("value") > 100))


@_R.query("SELECT p_partkey, coalesce(regexp_matches(CASE WHEN p_size > 10 THEN p_type END, '(?i)(?:^promo)|(?:steel$)'), false) AS pilot FROM part")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") > 10, F.col("p_type"))
    return Tables(spark, sf_dir).part.select("p_partkey", scalars.name_matches(name, ("^promo", "steel$")).alias("pilot"))


@_R.query("""
    WITH p AS (SELECT source, doc_id, lang AS b, n_chars, lag(lang) OVER w AS a, lag(doc_id) OVER w AS prev FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    s AS (SELECT *, least(n_chars, 1000) / 1000.0 AS score FROM p WHERE prev IS NOT NULL)
    SELECT source, doc_id, coalesce(a = 'en' AND b = 'en', false) AS reliable, coalesce(quality = 1, false) AS verified, score >= 0.999 OR score <= 0.001 AS degenerate FROM s LEFT JOIN labels USING (doc_id)
""")
def reliable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.text import adjacent_pairs

    t = Tables(spark, sf_dir)
    pairs = adjacent_pairs(t.documents, "source", "doc_id", ["lang", "n_chars"]).withColumnRenamed("doc_id_curr", "doc_id")
    score = F.least(F.col("n_chars_curr"), F.lit(1000)) / 1000.0
    return pairs.join(t.labels, "doc_id", "left").select(
        "source", "doc_id", scalars.both_reliable(F.col("lang_prev"), F.col("lang_curr"), "en").alias("reliable"), scalars.verified(F.col("quality") == 1).alias("verified"), scalars.degenerate_score(score).alias("degenerate")
    )


@_R.query("""
    WITH q AS (SELECT DISTINCT o_custkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS k FROM orders)
    SELECT o_custkey, quarter, lag(quarter) OVER (PARTITION BY o_custkey ORDER BY k) AS before, k - lag(k) OVER (PARTITION BY o_custkey ORDER BY k) AS gap FROM q
""")
def quarter_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = Tables(spark, sf_dir).orders.select("o_custkey", scalars.period_label(F.to_date("o_orderdate")).alias("quarter")).distinct()
    k = scalars.quarter_order(F.col("quarter"))
    order = W.partitionBy("o_custkey").orderBy(k)
    return rows.select("o_custkey", "quarter", F.lag("quarter").over(order).alias("before"), (k - F.lag(k).over(order)).alias("gap"))


def _panel(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(
        F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.count("*").cast("double").alias("size")
    )
    return rows.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey", "left")


_SPECS = {"none": [], "full": ["tax", "size"], "no_size": ["tax"]}


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(Tables(spark, sf_dir))
    cuts = {"price": rows.withColumn("y", F.col("price")), "quantity": rows.withColumn("y", F.col("quantity"))}
    found = stats.specifications(cuts, "y", "discount", _SPECS, "l_suppkey")
    kind = "scenario string, controls string, n long, coef double, p_value double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in found], kind)


@_R.query()
def specification_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_specs(spark, sf_dir))


@_R.query()
def specification_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.flips(_specs(spark, sf_dir), "full", "no_size"))


@_R.query()
def panel_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _panel(Tables(spark, sf_dir)).withColumn("east", (F.col("nation") > 12).cast("double"))
    found = stats.panel_battery(rows, ["price", "quantity"], ["discount"], ["tax", "size"], "l_suppkey", "year", ["east"], {"quantity": ["size"]})
    kind = "outcome string, predictor string, n long, r double, p_simple double, p_clustered double, p_controls double, p_sector double, p_fe double, p_least double"
    return rounded(spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in found], kind))


_PANEL_SQL = "d AS (SELECT l_suppkey, year(l_shipdate) AS year, avg(l_extendedprice) AS price, avg(l_discount) AS discount, count(*) AS size FROM lineitem GROUP BY 1, 2)"


@_R.query(f"""WITH {_PANEL_SQL}, x AS (SELECT a.l_suppkey, b.price, b.discount FROM (SELECT DISTINCT l_suppkey FROM d) a JOIN d b ON a.l_suppkey <> b.l_suppkey)
    SELECT l_suppkey, round(regr_slope(price, discount), 4) AS slope FROM x GROUP BY 1""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.leave_one_out(_panel(Tables(spark, sf_dir)), "price", ["discount"], "l_suppkey")
    return found.where("term = 'discount'").select("l_suppkey", F.round("coef", 4).alias("slope"))


@_R.query(f"""WITH {_PANEL_SQL}, c AS (SELECT l_suppkey, median(price) AS y, median(discount) AS x, count(*) AS w FROM d GROUP BY 1), m AS (SELECT sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM c)
    SELECT (SELECT count(*) FROM c) AS n, round(sum(c.w * (x - mx) * (y - my)) / sum(c.w * (x - mx) * (x - mx)), 4) AS slope FROM c, m""")
def collapsed_weighted_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.collapse(_panel(Tables(spark, sf_dir)), "l_suppkey", ["price", "discount"], "median")
    term = next(r for r in stats.ols(rows, "price", ["discount"], weight="n_rows") if r["term"] == "discount")
    return spark.createDataFrame([(term["n"], round(term["coef"], 4))], "n long, slope double")
