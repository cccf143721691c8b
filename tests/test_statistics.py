"""Statistics and registered queries without SQL against NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import portfolio, stats
from tidemark.plans import catalog, event_queries, panel_queries
from tidemark.plans.registry import Tables

QUERIES = catalog.queries()


def close(got, want, digits=6):
    assert got == pytest.approx(want, rel=1e-6, abs=10**-digits)


def brute_ols(y, x, groups, absorbed=0):
    """Coefficients, clustered errors and normal p of least squares on columns ``x``."""
    n, k = x.shape
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    bread = np.linalg.pinv(x.T @ x)
    scores = np.array([((x * (y - x @ beta)[:, None])[groups == g]).sum(axis=0) for g in np.unique(groups)])
    g = len(scores)
    se = np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * g / (g - 1) * (n - 1) / (n - k - absorbed))
    return beta, se, np.array([math.erfc(abs(b / s) / math.sqrt(2)) for b, s in zip(beta, se)])


def test_ols_with_controls(spark, sf_dir):
    rows = event_queries._ordered(Tables(spark, sf_dir)).toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[["x", "year", "month"]]])
    beta, se, p = brute_ols(rows["y"].to_numpy(), x, rows["o_custkey"].to_numpy())
    got = {r["term"]: r for r in QUERIES["clustered_ols_controls"](spark, sf_dir).collect()}
    for i, term in enumerate(("const", "x", "year", "month")):
        close([got[term]["coef"], got[term]["se"], got[term]["p"]], [beta[i], se[i], p[i]], 5)


def test_many_models_equal_single_ones(spark):
    """Two passes for all models and cuts: each has the rows, clusters, coefficients and errors of its own ``ols``."""
    draw = np.random.default_rng(10)
    rows = []
    for i in range(300):
        a, b, e = map(float, draw.normal(size=3))
        rows.append(("xy"[i % 2] if i % 50 else None, int(draw.integers(0, 25)) if i % 41 else None, a - b + e, a, b if i % 3 else None, 1.0))
    df = spark.createDataFrame(rows, "cut string, g long, y double, a double, b double, one double")
    models = {"alone": ("y", ["a"]), "both": ("y", ["a", "b"]), "same": ("b", ["a", "one"])}
    got = stats.ols_many(df, models, "g", "cut")
    assert {k[0] for k in got} == {"x", "y", None}
    for (value, name), cell in got.items():
        own = df.where(F.col("cut").eqNullSafe(F.lit(value)))
        want = stats.ols(own, models[name][0], models[name][1], "g")
        assert [t["term"] for t in cell["terms"]] == [t["term"] for t in want]
        for t, w in zip(cell["terms"], want):
            close([t["coef"], t["se"], t["n"], t["clusters"]], [w["coef"], w["se"], w["n"], w["clusters"]])
    assert stats.ols_many(df.where("false"), models, "g") == {}
    few = stats.ols_many(df.limit(2), models, "g")
    assert all(c["terms"] == [] for c in few.values())


def dummies(rows, entity, time, x):
    es, ts = sorted(set(rows[entity])), sorted(set(rows[time]))
    return np.column_stack([rows[x], *((rows[entity] == e).astype(float) for e in es), *((rows[time] == t).astype(float) for t in ts[1:])])


def test_two_way_effects(spark, sf_dir):
    panel = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("x"))
    rows = panel.toPandas()
    beta, *_ = np.linalg.lstsq(dummies(rows, "l_suppkey", "year", ["x"]), rows["y"].to_numpy(), rcond=None)
    close(QUERIES["two_way_fe"](spark, sf_dir).first()["coef"], beta[0], 4)


def test_two_way_effects_of_many_periods(spark):
    """An unbalanced panel of 250 periods, coefficient and error."""
    draw = np.random.default_rng(4)
    rows = [(e, t, float(draw.normal()), float(draw.normal())) for e in range(12) for t in range(250) if draw.random() < 0.7]
    rows = [(e, t, 1.5 * x + e + math.sin(t) + n, x) for e, t, n, x in rows]
    df = spark.createDataFrame(rows, "e long, t long, y double, x double")
    found = stats.two_way_fe(df, "y", ["x"], "e", "t")
    pdf = df.toPandas()
    y, x = pdf["y"].to_numpy(), dummies(pdf, "e", "t", ["x"])
    rest = x[:, 1:]
    net = lambda v: v - rest @ np.linalg.lstsq(rest, v, rcond=None)[0]
    beta, se, _ = brute_ols(net(y), net(x[:, 0])[:, None], pdf["e"].to_numpy(), absorbed=249)
    assert found["periods"] == 250
    close([found["terms"][0]["coef"], found["terms"][0]["se"]], [beta[0], se[0]])


def brute_fit(pdf, entity, time, y, x):
    """Within R2, poolability F and its degrees by dummies, without any demeaning of rows."""
    v, d = pdf[y].to_numpy(float), dummies(pdf, entity, time, x)
    rss = lambda m: float(((v - m @ np.linalg.lstsq(m, v, rcond=None)[0]) ** 2).sum())
    beta = np.linalg.lstsq(d, v, rcond=None)[0][: len(x)]
    means = pdf.groupby(entity)[[y, *x]].transform("mean")
    off = pdf[[y, *x]].to_numpy(float) - means.to_numpy()
    r2 = 1 - ((off[:, 0] - off[:, 1:] @ beta) ** 2).sum() / (off[:, 0] ** 2).sum()
    rank = int(np.linalg.matrix_rank(d[:, len(x) :]))
    num, den = rank - 1, len(v) - len(x) - rank
    pooled = rss(np.column_stack([np.ones(len(v)), pdf[x].to_numpy(float)]))
    return r2, (pooled - rss(d)) / num / (rss(d) / den), num, den


def unbalanced(spark, seed, entities=14, times=11, parts=1):
    draw = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        for t in range(times):
            if draw.random() < 0.6 and e % parts == t % parts:
                x, w = draw.normal(size=2)
                rows.append((e, t, float(1.5 * x - w + 0.3 * e + math.sin(t) + draw.normal()), float(x + 0.1 * e), float(w)))
    return spark.createDataFrame(rows, "e long, t long, y double, x double, w double")


@pytest.mark.parametrize("parts", [1, 2])
def test_within_r2_and_poolability(spark, parts):
    df = unbalanced(spark, 6, parts=parts)
    got, pdf = stats.two_way_fe(df, "y", ["x", "w"], "e", "t"), df.toPandas()
    r2, f, num, den = brute_fit(pdf, "e", "t", "y", ["x", "w"])
    close([got["r2_within"], got["f_pooled"], got["df_num"], got["df_den"]], [r2, f, num, den])
    # the tail by the sum of the density
    grid = np.linspace(0, f, 200_001)[1:]
    log = 0.5 * num * math.log(num / den) + math.lgamma((num + den) / 2) - math.lgamma(num / 2) - math.lgamma(den / 2)
    density = np.exp(log + (num / 2 - 1) * np.log(grid) - (num + den) / 2 * np.log1p(num * grid / den))
    close(got["poolability_p"], 1 - float((density[1:] + density[:-1]).sum() / 2 * (grid[1] - grid[0])), 4)
    beta, se, _ = brute_ols(pdf["y"].to_numpy(), np.column_stack([np.ones(len(pdf)), pdf[["x", "w"]]]), pdf["e"].to_numpy())
    close([t["coef"] for t in got["pooled"]], list(beta))
    close([t["se"] for t in got["pooled"]], list(se))


@pytest.mark.parametrize("parts", [1, 3])
def test_iterated_effects_equal_the_dense_system(spark, parts):
    df = unbalanced(spark, 7, entities=12, times=18, parts=parts)
    dense, iterated = (stats.two_way_fe(df, "y", ["x", "w"], "e", "t", dense_periods=n) for n in (100, 5))
    for k in ("r2_within", "f_pooled", "poolability_p"):
        assert iterated[k] == pytest.approx(dense[k], rel=1e-8)
    assert [iterated[k] for k in ("periods", "entities", "df_num", "df_den")] == [dense[k] for k in ("periods", "entities", "df_num", "df_den")]
    for a, b in zip(iterated["terms"], dense["terms"]):
        assert (a["coef"], a["se"]) == pytest.approx((b["coef"], b["se"]), rel=1e-8)


def test_fit_statistics_without_variation(spark):
    flat = stats.two_way_fe(spark.createDataFrame([(1, 1, 2.0, 1.0), (1, 2, 2.0, 3.0), (2, 1, 1.0, 2.0), (2, 2, 1.0, 5.0)], "e long, t long, y double, x double"), "y", ["x"], "e", "t")
    assert flat["degenerate"] and flat["r2_within"] is None and flat["poolability_p"] is None
    none = stats.two_way_fe(spark.createDataFrame([], "e long, t long, y double, x double"), "y", ["x"], "e", "t")
    assert none["degenerate"] and none["terms"] == [] and none["entities"] == 0


def test_two_way_fit_query(spark, sf_dir):
    panel = Tables(spark, sf_dir).lineitem.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("month")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("x"), F.avg("l_quantity").alias("w"))
    r2, f, num, den = brute_fit(panel.toPandas(), "l_suppkey", "month", "y", ["x", "w"])
    got = QUERIES["two_way_fit"](spark, sf_dir).first()
    close([got["r2_within"], got["f_pooled"], got["df_num"], got["df_den"]], [r2, f, num, den], 5)


def test_logit_with_clusters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id").select("source", "quality", F.log1p("n_chars").alias("size"), (F.col("lang") == "en").cast("double").alias("english")).toPandas()
    x, y, beta = np.column_stack([np.ones(len(rows)), rows[["size", "english"]]]), rows["quality"].to_numpy(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        beta = beta + bread @ x.T @ (y - p)
    scores = np.array([(x * (y - p)[:, None])[rows["source"] == g].sum(axis=0) for g in rows["source"].unique()])
    g, n = len(scores), len(rows)
    want = np.sqrt(np.diag(bread @ scores.T @ scores @ bread) * g / (g - 1) * (n - 1) / (n - 3))
    got = QUERIES["logit_clustered"](spark, sf_dir).collect()
    close([r["coef"] for r in got], list(beta), 4)
    close([r["se"] for r in got], list(want), 4)
    assert {r["clusters"] for r in got} == {g}
    one = spark.createDataFrame([(1, 0.0, 0.5), (1, 1.0, 0.4), (1, 1.0, 0.9), (1, 0.0, 0.8)], "g long, y double, x double")
    assert all(r["p"] is None for r in stats.logit(one, "y", ["x"], cluster="g"))


def test_exact_rank_sums_equal_enumeration(spark):
    for n1 in range(1, 9):
        for n0 in range(1, 9):
            if math.comb(n1 + n0, n1) <= 5000:
                us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n0 + 1), n1)]
                assert special.rank_sum_counts(n1, n0) == tuple(us.count(u) for u in range(n1 * n0 + 1))
    rows = [(1, 0.1), (1, 0.7), (1, 0.75), (0, 0.2), (0, 0.9), (0, 1.1), (0, 1.3)]
    us = [sum(c) - 6 for c in itertools.combinations(range(1, 8), 3)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {side: stats.mann_whitney(df, "v", "g", side).first() for side in ("two-sided", "less", "greater")}
    low = sum(u <= got["less"]["u"] for u in us) / len(us)
    close([got["less"]["p"], got["greater"]["p"], got["two-sided"]["p"]], [low, sum(u >= got["less"]["u"] for u in us) / len(us), min(1, 2 * low)])
    tied = stats.mann_whitney(spark.createDataFrame(rows + [(0, 0.1)], "g int, v double"), "v", "g").first()
    close(tied["p"], math.erfc(abs(tied["z"]) / math.sqrt(2)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cross_sections_and_quantiles_gather_nothing(spark):
    draw = np.random.default_rng(3)
    rows = [(m, k, *map(float, draw.normal(size=3)), 1.0) for m in range(4) for k in range(10 + 5 * m)] + [(None, 1, 0.0, 0.0, 0.0, 1.0), (1, 99, None, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "month long, k long, y double, a double, b double, one double")
    got = portfolio.residual_scores(df, "month", "k", "y", ["a", "b", "one"], 12)
    assert "FlatMapGroups" not in plan_of(got) and "SinglePartition" not in plan_of(got)
    found = {(r["month"], r["k"]): r["residual"] for r in got.collect()}
    pdf = df.dropna().toPandas()
    for m in range(1, 4):
        own = pdf[pdf["month"] == m]
        x, y = np.column_stack([np.ones(len(own)), own[["a", "b"]]]), own["y"].to_numpy()
        close([found[m, k] for k in own["k"]], list(y - x @ np.linalg.lstsq(x, y, rcond=None)[0]))
    assert {m for m, _ in found} == {1, 2, 3}  # the first has ten names only


@pytest.mark.parametrize("kind", ["few", "wild", "tied", "ends", "lump", "far"])
def test_quantiles_of_odd_values(spark, kind):
    draw = np.random.default_rng(8)
    v = {
        "few": np.array([3.0]), "wild": np.exp(draw.normal(size=9000) * 40) * draw.choice([-1, 1], 9000),
        "tied": draw.integers(0, 3, 9000).astype(float), "lump": np.concatenate([draw.normal(size=9000), np.zeros(3000), np.full(4000, 0.7)]),
        "far": np.concatenate([np.linspace(0, 1, 30000) ** 9, [1e200]]), "ends": np.array([-1e300, 1e300, 0.0, 1e-300, -1e-300] * 40 + [5.0]),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    shares = (0, 0.001, 0.25, 0.5, 0.77, 0.999, 1)
    assert stats.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(v, shares)), rel=1e-12)


def test_logit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.documents.join(t.labels, "doc_id").select("quality", F.log1p("n_chars").alias("size"), (F.col("lang") == "en").cast("double").alias("english")).toPandas()
    x, y, beta = np.column_stack([np.ones(len(rows)), rows[["size", "english"]]]), rows["quality"].to_numpy(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        beta = beta + cov @ x.T @ (y - p)
    got = QUERIES["logit_group"](spark, sf_dir).collect()
    close([r["coef"] for r in got], list(beta), 4)
    close([r["se"] for r in got], list(np.sqrt(np.diag(cov))), 4)


def ranks(v):
    v = np.asarray(v)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_battery(spark, sf_dir):
    rows = event_queries._ordered(Tables(spark, sf_dir)).toPandas()
    got = {(r["label"], r["test"]): r for r in QUERIES["test_battery"](spark, sf_dir).collect()}
    x, y, g = rows["x"].to_numpy(), rows["y"].to_numpy(), rows["o_custkey"].to_numpy()
    close(got["all", "signed_pearson"]["stat"], np.corrcoef(x, y)[0, 1])
    close(got["all", "magnitude_pearson"]["stat"], np.corrcoef(x, abs(y))[0, 1])
    close(got["all", "signed_spearman"]["stat"], np.corrcoef(ranks(x), ranks(y))[0, 1])
    for test, names in (("clustered_ols_no_controls", ["x"]), ("clustered_ols_with_controls", ["x", "year", "month"])):
        beta, _, p = brute_ols(y, np.column_stack([np.ones(len(x)), rows[names]]), g)
        close([got["all", test]["stat"], got["all", test]["p_value"]], [beta[1], p[1]], 5)
    third = np.searchsorted(np.quantile(x, [1 / 3, 2 / 3]), x, side="left")
    r, n = ranks(y), len(y)
    h = 12 / (n * (n + 1)) * sum(r[third == k].sum() ** 2 / (third == k).sum() for k in range(3)) - 3 * (n + 1)
    ties = sum(c**3 - c for c in np.unique(y, return_counts=True)[1])
    close(got["all", "tercile_kruskal"]["stat"], h / (1 - ties / (n**3 - n)))
    close(got["all", "tercile_kruskal"]["p_value"], math.exp(-h / 2), 4)  # two degrees of freedom
    assert got["none", "coverage_too_low"]["n"] == 0


def test_specifications_and_panel_battery(spark, sf_dir):
    base = sf_dir.replace("0.001", "0.01")
    rows = panel_queries._panel(Tables(spark, base)).toPandas()
    g = rows["l_suppkey"].to_numpy()

    def p_of(y, names):
        return brute_ols(rows[y].to_numpy(), np.column_stack([np.ones(len(rows)), rows[["discount", *names]]]), g)[2][1]

    got = QUERIES["specification_comparison"](spark, base).collect()
    assert len(got) == 6
    for r in got:
        close(r["p_value"], p_of(r["scenario"], panel_queries._SPECS[r["controls"]]), 5)
    flips = {r["scenario"] for r in QUERIES["specification_flips"](spark, base).collect()}
    p = {(r["scenario"], r["controls"]): r["p_value"] for r in got}
    assert flips == {s for s in ("price", "quantity") if p[s, "full"] >= 0.05 > p[s, "no_size"]}
    made = spark.createDataFrame([("a", "full", 0.2), ("a", "no_size", 0.01), ("b", "full", 0.01), ("b", "no_size", 0.01)], "scenario string, controls string, p_value double")
    assert [r["scenario"] for r in stats.flips(made, "full", "no_size").collect()] == ["a"]
    rows["east"] = (rows["nation"] > 12).astype(float)
    for r in QUERIES["panel_battery"](spark, base).collect():
        own = ["tax"] if r["outcome"] == "quantity" else ["tax", "size"]
        close([r["p_clustered"], r["p_controls"], r["p_sector"]], [p_of(r["outcome"], c) for c in ([], own, [*own, "east"])], 5)
        ps = [r[c] for c in ("p_simple", "p_clustered", "p_controls", "p_sector", "p_fe")]
        assert r["p_least"] == min(ps) and None not in ps


def test_quantiles_and_ranks(spark):
    draw = np.random.default_rng(7)
    for v in (draw.integers(0, 20, 3000).astype(float), draw.normal(size=3000), np.array([3.0]), np.full(50, 2.0)):
        df = spark.createDataFrame([(i, float(a), i % 3) for i, a in enumerate(v)], "i long, v double, k long").repartition(5)
        shares = (0, 0.01, 1 / 3, 0.5, 0.9, 1)
        close(stats.quantiles(df, "v", shares), list(np.quantile(v, shares)))
        assert [r["rank"] for r in stats.average_ranks(df, "v").orderBy("i").collect()] == list(ranks(v))
        per = {r["k"]: r["q"] for r in stats.grouped_quantiles(df, ["k"], "v", shares, "q").collect()}
        for k, q in per.items():
            close(list(q), list(np.quantile(v[np.arange(len(v)) % 3 == k], shares)))
    none = df.where("false")
    assert stats.quantiles(none, "v", (0.5,)) is None and stats.average_ranks(none, "v").count() == 0 and portfolio.qcut(none, [], "v", 3).count() == 0


def test_one_sided_rank_test(spark):
    df = spark.createDataFrame([(float(i), int(i >= 12)) for i in range(20)], "v double, g int")
    p = {side: stats.mann_whitney(df, "v", "g", side).first()["p"] for side in ("less", "greater", "two-sided")}
    assert p["greater"] < 0.01 < 0.99 < p["less"] and p["two-sided"] == pytest.approx(2 * p["greater"])


def test_characteristic_adjusted(spark, sf_dir):
    """The registered query against a walk over months."""
    t = Tables(spark, sf_dir.replace("0.001", "0.01"))
    held, rets = event_queries._positions(t, 3).toPandas(), event_queries._returns(t).toPandas()
    got = {r["month"]: r for r in QUERIES["characteristic_adjusted_spread"](spark, t.sf_dir).collect()}
    seen = 0
    for month, rows in held.groupby("month"):
        rows = rows.sort_values(["filed", "l_orderkey", "score", "size"]).drop_duplicates("k", keep="last")
        rows = rows.merge(rets[rets["month"] == month][["k", "ret"]], on="k").dropna(subset=["ret"])
        if len(rows) < 8:
            assert str(month) not in got
            continue
        x, y = np.column_stack([np.ones(len(rows)), rows[["size", "discount"]]]), rows["ret"].to_numpy()
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        edges = np.quantile(rows["score"], [1 / 3, 2 / 3])
        third = np.searchsorted(edges, rows["score"], side="left")
        close(got[str(month)]["spread"], rest[third == 2].mean() - rest[third == 0].mean(), 5)
        seen += 1
    assert seen == len(got) > 50
