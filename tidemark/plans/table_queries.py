"""Relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational as rel
from .registry import Registry, Tables, rounded

_R = Registry()
QUERIES, ORACLE = _R.queries, _R.oracle
TYPES = ("click", "error", "purchase", "signup", "view")


@_R.query("""
    SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""", dates=("day",))
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.withColumn("day", F.to_date("o_orderdate"))
    return rel.latest_version(orders, ["o_custkey"], "day", "o_orderkey").select("o_custkey", "o_orderkey", "day", "o_totalprice")


@_R.query("""
    WITH u AS (SELECT o_custkey, o_orderkey, 0 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders)
    SELECT o_custkey, o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) = 1
""")
def priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    frames = [orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), orders.drop("o_orderstatus")]
    return rel.union_by_priority(frames, ["o_custkey"], "o_orderkey")


@_R.query("""
    WITH a AS (SELECT l_partkey, round(sum(l_quantity), 2) AS qty, CASE WHEN min(l_discount) > 0 THEN min(l_discount) END AS disc FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A' GROUP BY 1),
    b AS (SELECT l_partkey, round(sum(l_quantity), 2) AS qty, min(l_discount) AS disc FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R' GROUP BY 1)
    SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.qty, b.qty) AS qty, coalesce(a.disc, b.disc) AS disc FROM a FULL JOIN b ON a.l_partkey = b.l_partkey
""")
def coalesced_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Tables(spark, sf_dir).lineitem
    side = lambda s, f, d: items.where((F.col("l_linestatus") == s) & (F.col("l_returnflag") == f)).groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), d.alias("disc"))
    low = F.min("l_discount")
    return rel.coalesce_outer(side("F", "A", F.when(low > 0, low)), side("O", "R", low), ["l_partkey"])


@_R.query("""
    WITH f AS (SELECT l_suppkey, l_returnflag, l_extendedprice FROM lineitem
               QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_extendedprice, l_orderkey) = 1)
    SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS "A", max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS "N",
           max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS "R" FROM f GROUP BY 1
""")
def account_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_extendedprice", "l_orderkey")]
    return rel.pivot_first(Tables(spark, sf_dir).lineitem, ["l_suppkey"], "l_returnflag", "l_extendedprice", ["A", "N", "R"], order)


@_R.query(f"SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"''' for t in TYPES)} FROM events GROUP BY user_id")
def crosstab_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.crosstab(Tables(spark, sf_dir).events, "user_id", "event_type", TYPES)


@_R.query("""
    SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
           round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
    FROM events GROUP BY 1
""")
def describe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.describe(Tables(spark, sf_dir).events, ["event_type"], "value")


@_R.query("SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def grouped_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.value_counts(Tables(spark, sf_dir).documents, "source", "lang")


@_R.query("""
    WITH j AS (SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'quality' AS column_name, round(avg((quality IS NOT NULL)::INT), 6) AS share FROM j UNION ALL SELECT 'toxic', round(avg((toxic IS NOT NULL)::INT), 6) FROM j
""")
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return rounded(rel.coverage(t.documents.join(t.labels, "doc_id", "left"), ["quality", "toxic"]))


@_R.query(f"""
    WITH c AS (SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"''' for t in TYPES)} FROM events GROUP BY 1)
    SELECT user_id, round(("click" + "view") / nullif("click" + "error" + "purchase" + "signup" + "view", 0)::DOUBLE, 6) AS share, ("click" + "view") > 0 AS has_any FROM c
""")
def share_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rel.crosstab(Tables(spark, sf_dir).events, "user_id", "event_type", TYPES)
    share = rel.share_of(["click", "view"], TYPES)
    return counts.select("user_id", scalars.nearest(share, 6).alias("share"), F.coalesce(share > 0, F.lit(False)).alias("has_any"))


@_R.query("""
    WITH w AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY 1)
    SELECT o_custkey, round(CASE WHEN f IS NOT NULL OR p IS NOT NULL THEN coalesce(f, 0) + coalesce(p, 0) END, 2) AS total, round(CASE WHEN abs(f) > 0.01 THEN p / f END, 6) AS ratio FROM w
""")
def row_sums_and_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    wide = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(best("F").alias("f"), best("P").alias("p"))
    return wide.select("o_custkey", F.round(rel.row_sum(["f", "p"], 1), 2).alias("total"), scalars.nearest(scalars.guarded_ratio(F.col("p"), F.col("f")), 6).alias("ratio"))


@_R.query(r"""
    WITH n AS (SELECT c_name, c_acctbal, regexp_replace(c_name, '\d+$', '') AS issuer FROM customer), i AS (SELECT unnest(['Customer#', 'Supplier#']) AS issuer)
    SELECT issuer, c_name, c_acctbal FROM i LEFT JOIN n USING (issuer) QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY c_acctbal DESC, c_name) = 1
""")
def prefix_key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Tables(spark, sf_dir).customer.select("c_name", "c_acctbal")
    issuers = spark.createDataFrame([("Customer#",), ("Supplier#",)], "issuer string")
    return rel.resolve_by_prefix(customers, issuers, "c_name", "issuer", "c_acctbal")


@_R.query("""
    SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'buyer' ELSE 'idle' END AS kind FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'MACHINERY')
""")
def semi_anti_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    chosen = t.customer.where(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY")).select("c_custkey")
    keys = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    buyers, idle = chosen.join(keys, "c_custkey", "left_semi"), chosen.join(keys, "c_custkey", "left_anti")
    return buyers.withColumn("kind", F.lit("buyer")).unionByName(idle.withColumn("kind", F.lit("idle")))


@_R.query("""
    SELECT n_name, r_name, count(c_custkey) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def enriched_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    nations = rel.bounded_lookup(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).withColumnRenamed("n_nationkey", "c_nationkey")
    joined = rel.bounded_lookup(t.customer, nations, ["c_nationkey"])
    return joined.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@_R.query("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS period FROM orders
    WHERE strftime(o_orderdate, '%m-%d') IN ('03-31', '06-30', '09-30')
""")
def quarter_end_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return Tables(spark, sf_dir).orders.where(scalars.quarter_end(day)).select("o_orderkey", scalars.period_label(day).alias("period"))


@_R.query("""
    SELECT user_id, event_type, n FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1)
    UNPIVOT (n FOR event_type IN (click, view))
""")
def melted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rel.crosstab(Tables(spark, sf_dir).events, "user_id", "event_type", ["click", "view"])
    return wide.unpivot(["user_id"], ["click", "view"], "event_type", "n")


@_R.query("""
    WITH s AS (SELECT user_id, min(ts::DATE) FILTER (WHERE value IS NOT NULL AND event_type = 'purchase') AS first FROM events GROUP BY 1)
    SELECT coalesce(strftime(first, '%Y-%m'), 'No data') AS bucket, count(*) AS n FROM s GROUP BY 1
""")
def first_valid_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.min(F.when(F.col("value").isNotNull() & (F.col("event_type") == "purchase"), F.to_date("ts")))
    firsts = Tables(spark, sf_dir).events.groupBy("user_id").agg(seen.alias("first"))
    return firsts.groupBy(F.coalesce(F.date_format("first", "yyyy-MM"), F.lit("No data")).alias("bucket")).agg(F.count("*").alias("n"))
