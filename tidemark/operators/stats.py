"""Statistics from grouped sums: ranks, quantiles, correlations, rank tests, least squares, fixed effects.

Only moments reach the driver: k x k cross products, never rows. Ranks come from value counts: ties
are one row, values are dealt into ranges of about equal weight, running sums stay inside a range and
only the ranges' totals, ``RANGES`` numbers, are added up on the driver.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from .lineage import cut

RANGES = 64


def _edges_below(value: Column, edges: Sequence, first: int = 0) -> Column:
    """How many of the ascending ``edges`` are smaller than ``value``, by halving, in generated code."""
    if not edges:
        return F.lit(first)
    half = len(edges) // 2
    return F.when(value > F.lit(edges[half]), _edges_below(value, edges[half + 1 :], first + half + 1)).otherwise(_edges_below(value, edges[:half], first))


def value_ranks(df: DataFrame, value: str, rank: str = "rank", count: Column | None = None) -> DataFrame:
    """``(value, t, rank)`` of the distinct non-null values: how many rows have each (or the sum of
    ``count``), and their mean rank from 1. To join the ranks with ``df`` by value, ``cut`` it before: values
    that were summed may differ in the last bit when they are summed anew in another order of rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg((F.count("*") if count is None else F.sum(count)).alias("t"))
    edges = df.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    edges = sorted(set(edges))
    dealt = counts.withColumn("_range", _edges_below(F.col(value), edges))
    totals = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.sum("t").alias("n")).collect())
    before, starts = 0, []
    for k, n in totals:
        starts += [F.lit(k), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*starts), F.col("_range")) if starts else F.lit(0)
    inside = F.sum("t").over(W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return dealt.select(value, "t", (offset + inside - (F.col("t") - 1) / 2.0).alias(rank))


def average_ranks(df: DataFrame, value: str, rank: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean; nulls are left out."""
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = cut(rows)
        return rows.join(value_ranks(rows, value, rank).drop("t"), value).select(*df.columns, rank)
    tied = W.partitionBy(*keys, value)
    return rows.withColumn(rank, F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(tied) - 1) / 2.0)


BUCKETS = 1024
#: Rows of a range up to which its values are counted one by one.
FEW = 4096


def _order(v: float) -> tuple[int, float]:
    """Numbers in Spark's order, where NaN follows all."""
    return (1, 0.0) if v != v else (0, v)


def _slots(brackets: Sequence[tuple[float, float]]) -> Column:
    """Ranges of ``v``, numbered upwards: each bracket in ``BUCKETS`` even parts, and what lies between."""
    merged: list[tuple[float, float]] = []
    for a, b in sorted(brackets, key=lambda x: (_order(x[0]), _order(x[1]))):
        if merged and _order(a) <= _order(merged[-1][1]):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1], key=_order))
        else:
            merged.append((a, b))
    v, at, slot = F.col("v"), None, 0
    for a, b in merged:
        even = F.floor(F.nanvl((v - F.lit(a)) / F.lit((b - a) or 1.0), F.lit(0.0)) * BUCKETS)
        inside = F.least(even, F.lit(BUCKETS - 1)) + slot + 1
        at = (F.when if at is None else at.when)(v < F.lit(a), F.lit(slot)).when(v <= F.lit(b), inside)
        slot += BUCKETS + 1
    return at.otherwise(F.lit(slot)).cast("int")


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float] | None:
    """Exact quantiles by linear interpolation, None for no rows, by successive ranges for all places at once.
    Approximate quantiles bracket the places; values are counted in even ranges of the brackets, with their
    extremes, and the ranges that hold places are searched in the same way, until a range has one value or
    ``FEW`` rows, whose values are counted. No value is sorted, each turn leaves a small share of the values,
    and the driver gets a row for each range."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    v, margin = F.col("v"), 2 / BUCKETS
    clip = lambda share: min(1.0, max(0.0, share))
    around = sorted({clip(s + d) for s in shares for d in (-margin, margin)})
    r = rows.agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, around, 10_000).alias("near")).first()
    n = r["n"]
    if not n:
        return None
    known = {0: r["low"], n - 1: r["high"]}
    places = sorted({f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)})
    near = dict(zip(around, r["near"]))
    brackets = [[(near[clip(s - margin)], near[clip(s + margin)]) for s in shares]]
    ranges = [(r["low"], r["high"], 0, n)] if any(k not in known for k in places) else []  # ends, rows before and inside

    def held(low: float, high: float) -> Column:
        return v.between(F.lit(low), F.lit(high))

    def within(before: int, size: int) -> list[int]:
        return [k for k in places if k not in known and before <= k < before + size]

    while ranges:
        few, ranges = [x for x in ranges if x[3] <= FEW], [x for x in ranges if x[3] > FEW]
        if few:
            counted = rows.where(functools.reduce(operator.or_, (held(a, b) for a, b, _, _ in few))).groupBy("v").agg(F.count("*").alias("n")).collect()
            counted.sort(key=lambda r: _order(r["v"]))
            for low, high, before, _ in few:
                for r in counted:
                    if _order(low) <= _order(r["v"]) <= _order(high):
                        known |= dict.fromkeys(within(before, r["n"]), r["v"])
                        before += r["n"]
        if not ranges:
            break
        if brackets is None:
            near_to = [[[clip((k - before + 0.5) / size + d) for d in (-margin, margin)] for k in within(before, size)] for _, _, before, size in ranges]
            found = rows.agg(*(F.percentile_approx(F.when(held(a, b), v), [s for pair in pairs for s in pair], 10_000).alias(f"q{i}") for i, ((a, b, _, _), pairs) in enumerate(zip(ranges, near_to)))).first()
            brackets = [list(zip(q[::2], q[1::2])) for q in found]
        which, at = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, ((a, b, _, _), own) in enumerate(zip(ranges, brackets)):
            which, at = F.when(held(a, b), F.lit(i)).otherwise(which), F.when(held(a, b), _slots(own)).otherwise(at)
        tagged = rows.select("v", which.alias("i"), at.alias("at")).where("i is not null")
        counts = sorted(tagged.groupBy("i", "at").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect())
        before, found = [x[2] for x in ranges], []
        for r in counts:
            if own := within(before[r["i"]], r["n"]):
                if _order(r["a"]) == _order(r["b"]):
                    known |= dict.fromkeys(own, r["a"])
                else:
                    found.append((r["a"], r["b"], before[r["i"]], r["n"]))
            before[r["i"]] += r["n"]
        ranges, brackets = found, None
    out = []
    for s in shares:
        low, high = known[math.floor(s * (n - 1))], known[math.ceil(s * (n - 1))]
        out.append(low if low == high else low + (s * (n - 1) - math.floor(s * (n - 1))) * (high - low))
    return out


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], name: str) -> DataFrame:
    """``(keys, name)``: exact quantiles of each group as an array, from counts of distinct values in
    order, so that a large group is sorted, and spills, instead of being held in memory."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_t"))
    whole = W.partitionBy(*keys)
    upto = F.sum("_t").over(whole.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    rows = counts.withColumn("_c", upto).withColumn("_n", F.sum("_t").over(whole))
    low = lambda s: F.floor(F.lit(s) * (F.col("_n") - 1))
    high = lambda s: F.ceil(F.lit(s) * (F.col("_n") - 1))
    picks = [F.min(F.when(F.col("_c") > f(s), F.col("_v"))).alias(f"_{x}{i}") for i, s in enumerate(shares) for x, f in (("a", low), ("b", high))]
    found = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    part = lambda s: F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1))
    return found.select(*keys, F.array(*(F.col(f"_a{i}") + part(s) * (F.col(f"_b{i}") - F.col(f"_a{i}")) for i, s in enumerate(shares))).alias(name))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(n, r, p)``, p two-sided by the t statistic."""
    return df.dropna(subset=[x, y]).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).withColumn("p", _tail(correlation_p, "n", "r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(n, r, p)`` of the average ranks."""
    pairs = cut(df.dropna(subset=[x, y]).groupBy(F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_c")))
    rx = value_ranks(pairs, "_x", "rx", F.col("_c")).drop("t")
    ry = value_ranks(pairs, "_y", "ry", F.col("_c")).drop("t")
    c = F.col("_c")
    m = pairs.join(rx, "_x").join(ry, "_y").agg(
        F.sum(c).alias("n"), F.sum(c * F.col("rx")).alias("sx"), F.sum(c * F.col("ry")).alias("sy"), F.sum(c * F.col("rx") * F.col("rx")).alias("xx"),
        F.sum(c * F.col("ry") * F.col("ry")).alias("yy"), F.sum(c * F.col("rx") * F.col("ry")).alias("xy"),
    )
    n = F.col("n")
    r = F.try_divide(n * F.col("xy") - F.col("sx") * F.col("sy"), F.sqrt((n * F.col("xx") - F.col("sx") * F.col("sx")) * (n * F.col("yy") - F.col("sy") * F.col("sy"))))
    return m.select("n", r.alias("r")).withColumn("p", _tail(correlation_p, "n", "r"))


def correlation_p(n: int, r: float | None) -> float | None:
    """Two-sided p of a correlation by its t statistic."""
    if r is None or n is None or n < 3 or r != r:
        return None
    return 0.0 if abs(r) >= 1 else special.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _tail(find, *columns) -> Column:
    """A tail probability as a column, of results that have a row in all or one a key."""
    return F.udf(lambda *v: None if any(x is None or x != x for x in v) else find(*v), "double")(*columns)


def _normal(z: float, side: str) -> float:
    return {"two-sided": special.normal_two_sided, "less": special.normal_lower, "greater": lambda v: special.normal_lower(-v)}[side](z)


def normal_p(z: Column | str, side: str = "two-sided") -> Column:
    return _tail(_normal, z, F.lit(side))


#: The smaller group, and pairs of rows of both, up to which ranks without ties have an exact distribution here.
EXACT_GROUP, EXACT_PAIRS = 8, 100_000


def _rank_p(z: float | None, u: float | None, n1: int, n0: int, ties: float, side: str) -> float | None:
    if z is None or u is None:
        return None
    if ties or min(n1, n0) > EXACT_GROUP or n1 * n0 > EXACT_PAIRS:
        return _normal(z, side)
    return special.rank_sum_tail(u, n1, n0, side)


def mann_whitney(df: DataFrame, value: str, group: str, side: str = "two-sided") -> DataFrame:
    """``(n1, n0, u, z, p)`` of group 1 against group 0: tie-corrected normal score with continuity;
    ``side`` is ``two-sided``, ``less`` (group 1 lower) or ``greater``. Without ties and with
    ``EXACT_GROUP`` rows at most in a group, p is that of the exact distribution of u."""
    rows = df.dropna(subset=[value, group]).where(F.col(group).isin(0, 1))
    ones = cut(rows.groupBy(value).agg(F.count("*").alias("_c"), F.count_if(F.col(group) == 1).alias("t1")))
    sums = value_ranks(ones, value, count=F.col("_c")).join(ones, value).agg(
        F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n0"), F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum(F.pow("t", 3) - F.col("t")).alias("ties")
    )
    n = F.col("n1") + F.col("n0")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    gap = u - F.col("n1") * F.col("n0") / 2
    var = F.col("n1") * F.col("n0") / 12 * (n + 1 - F.try_divide("ties", n * (n - 1)))
    step = {"two-sided": F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), "less": gap + 0.5, "greater": gap - 0.5}[side]
    p = F.udf(_rank_p, "double")("z", "u", "n1", "n0", "ties", F.lit(side))
    return sums.select("n1", "n0", u.alias("u"), F.try_divide(step, F.sqrt(var)).alias("z"), "ties").withColumn("p", p).drop("ties")


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """``(k, n, h, p)``: tie-corrected H over the groups, p by chi-squared."""
    counts = cut(df.dropna(subset=[value, group]).groupBy(value, group).agg(F.count("*").alias("c")))
    ranks = value_ranks(counts, value, count=F.col("c"))
    cells = counts.join(ranks, value)
    per = cells.groupBy(group).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    all_of = per.agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("c")).alias("q"))
    ties = ranks.agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    return all_of.crossJoin(F.broadcast(ties)).select("k", "n", h.alias("h")).withColumn("p", _tail(lambda h, k: special.chi2_upper(h, k) if k else None, "h", F.col("k") - 1))


def ols(df: DataFrame, y: str, x: Sequence[str], cluster: str | None = None, intercept: bool = True, weight: str | None = None, absorbed: int = 0) -> list[dict]:
    """Least squares with cluster-robust errors, factor ``G/(G-1) (N-1)/(N-K)``, normal p.

    Pass one sums cross products; pass two sums scores per cluster and then their outer products, so
    the driver gets ``k * k`` numbers twice. Nulls are dropped. ``weight`` names a column of weights;
    ``absorbed`` parameters, estimated before, count in K. Every term has the residual sum ``rss``.
    """
    names = (["const"] if intercept else []) + list(x)
    kept = df.dropna(subset=[y, *x, *([cluster] if cluster else []), *([weight] if weight else [])])
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w")
    rows = kept.select(
        *([F.lit(1.0).alias("const")] if intercept else []), *(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("_y"), w,
        *([F.col(cluster).alias("_g")] if cluster else [F.monotonically_increasing_id().alias("_g")]),
    )
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = rows.agg(
        F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j]) * F.col("_w")).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(F.col(c) * F.col("_y") * F.col("_w")).alias(f"t{i}") for i, c in enumerate(names))
    ).first()
    n = first["n"]
    if n <= k + absorbed:
        return []
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = first[f"s{i}_{j}"]
    xy = np.array([first[f"t{i}"] for i in range(k)])
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    e = F.col("_y") - sum((F.col(c) * float(b) for c, b in zip(names, beta)), F.lit(0.0))
    scored = rows.groupBy("_g").agg(F.sum(F.col("_w") * e * e).alias("rss"), *(F.sum(F.col(c) * F.col("_w") * e).alias(f"u{i}") for i, c in enumerate(names)))
    meat_row = scored.agg(F.count("*").alias("g"), F.sum("rss").alias("rss"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
    meat, g = np.zeros((k, k)), meat_row["g"]
    for i, j in pairs:
        meat[i, j] = meat[j, i] = meat_row[f"m{i}_{j}"]
    factor = (g / (g - 1)) * (n - 1) / (n - k - absorbed) if g > 1 else float("nan")
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))
    return [
        {"term": t, "coef": float(b), "se": float(s), "z": float(b / s) if s > 0 else None, "p": special.normal_two_sided(b / s) if s > 0 else None, "n": n, "clusters": g, "rss": meat_row["rss"]}
        for t, b, s in zip(names, beta, se)
    ]


def ols_many(df: DataFrame, models: dict[str, tuple[str, Sequence[str]]], cluster: str, by: str | None = None) -> dict[tuple, dict]:
    """``ols`` with an intercept for every model, a name to ``(y, x)``, and every value of ``by``, in two passes
    over the rows for all of them: ``(value, name)`` to ``{"n", "clusters", "terms"}``.

    Each model drops the rows that lack one of its own columns. A model has no terms where its rows aren't
    more than its parameters. The driver gets a row per value of ``by`` twice."""
    wanted = sorted({c for y, x in models.values() for c in (y, *x)})
    at = {c: f"_c{i}" for i, c in enumerate(wanted)}
    rows = df.where(F.col(cluster).isNotNull()).select(
        (F.col(by) if by else F.lit(0)).alias("_b"), F.col(cluster).alias("_g"), *(F.col(c).cast("double").alias(at[c]) for c in wanted)
    )
    parts = []  # of each model: its own rows, outcome, regressors
    for y, x in models.values():
        whole = F.lit(True)
        for c in (y, *x):
            whole = whole & F.col(at[c]).isNotNull()
        parts.append((whole, F.col(at[y]), [F.lit(1.0), *(F.col(at[c]) for c in x)]))
    pairs = [[(i, j) for i in range(len(cols)) for j in range(i, len(cols))] for _, _, cols in parts]

    firsts, totals = [], []
    for m, (whole, out, cols) in enumerate(parts):
        products = [F.when(whole, cols[i] * cols[j]) for i, j in pairs[m]] + [F.when(whole, c * out) for c in cols]
        firsts += [F.count_if(whole).alias(f"n{m}"), *(F.sum(v).alias(f"s{m}_{i}") for i, v in enumerate(products))]
        totals += [F.sum(f"n{m}").alias(f"n{m}"), F.count_if(F.col(f"n{m}") > 0).alias(f"g{m}"), *(F.sum(f"s{m}_{i}").alias(f"s{m}_{i}") for i in range(len(products)))]
    found: dict[tuple, dict] = {}
    fits: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    values = []
    for r in rows.groupBy("_b", "_g").agg(*firsts).groupBy("_b").agg(*totals).collect():
        values.append(r["_b"])
        for m, name in enumerate(models):
            k = len(parts[m][2])
            found[r["_b"], name] = {"n": r[f"n{m}"], "clusters": r[f"g{m}"], "terms": []}
            if r[f"n{m}"] > k:
                sums = [r[f"s{m}_{i}"] for i in range(len(pairs[m]) + k)]
                xx = np.zeros((k, k))
                for (i, j), v in zip(pairs[m], sums):
                    xx[i, j] = xx[j, i] = v
                inverse = np.linalg.pinv(xx)
                fits[r["_b"], m] = inverse, inverse @ np.array(sums[len(pairs[m]) :])
    if not fits:
        return found
    lines = [(b, *([float(v) for v in fits[b, m][1]] if (b, m) in fits else None for m in range(len(parts)))) for b in values]
    kind = rows.select("_b").schema
    for m in range(len(parts)):
        kind = kind.add(f"b{m}", T.ArrayType(T.DoubleType()))
    betas = F.broadcast(df.sparkSession.createDataFrame(lines, kind))
    scores, meats = [], []
    for m, (whole, out, cols) in enumerate(parts):
        e = out - sum((c * F.col(f"b{m}")[i] for i, c in enumerate(cols)), F.lit(0.0))
        scores += [F.sum(F.when(whole, c * e)).alias(f"u{m}_{i}") for i, c in enumerate(cols)]
        meats += [F.sum(F.col(f"u{m}_{i}") * F.col(f"u{m}_{j}")).alias(f"m{m}_{i}_{j}") for i, j in pairs[m]]
    for r in rows.join(betas, rows["_b"].eqNullSafe(betas["_b"])).drop(betas["_b"]).groupBy("_b", "_g").agg(*scores).groupBy("_b").agg(*meats).collect():
        for m, (name, (_, x)) in enumerate(models.items()):
            if (r["_b"], m) not in fits:
                continue
            (inverse, beta), cell = fits[r["_b"], m], found[r["_b"], name]
            k, n, g = len(beta), cell["n"], cell["clusters"]
            meat = np.zeros((k, k))
            for i, j in pairs[m]:
                meat[i, j] = meat[j, i] = r[f"m{m}_{i}_{j}"]
            factor = g / (g - 1) * (n - 1) / (n - k) if g > 1 else math.nan
            se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))
            cell["terms"] = [
                {"term": t, "coef": float(b), "se": float(s), "z": float(b / s) if s > 0 else None, "p": special.normal_two_sided(b / s) if s > 0 else None, "n": n, "clusters": g}
                for t, b, s in zip(["const", *x], beta, se)
            ]
    return found


def demean(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    w = W.partitionBy(by)
    return df.select(*(c for c in df.columns if c not in columns), *((F.col(c) - F.avg(c).over(w)).alias(c) for c in columns))


def _outer(size: int):
    """Sums over entities of outer products of their period counts, divided by the entity's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for cells in b.column("cells").to_pylist():
                at = np.array([c["t"] for c in cells])
                n = np.array([c["c"] for c in cells], float)
                total[np.ix_(at, at)] += np.outer(n, n) / n.sum()
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def _dense_effects(within: DataFrame, values: Sequence[str], periods: list) -> tuple[DataFrame, int]:
    """Time effects ``(_time, _e0, ...)`` of the entity-demeaned ``values`` by one periods-by-periods system
    on the driver, and the number of parts of the panel that share no entity."""
    spark = within.sparkSession
    number = spark.createDataFrame(list(zip(periods, range(len(periods)))), within.select("_time").schema.add("_t", T.IntegerType()))
    numbered = within.join(F.broadcast(number), "_time")
    cells = numbered.groupBy("_i", "_t").agg(F.count("*").alias("c")).groupBy("_i").agg(F.collect_list(F.struct(F.col("_t").alias("t"), "c")).alias("cells"))
    products = cells.select("cells").mapInArrow(_outer(len(periods)), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    by_time = {r["_t"]: r for r in numbered.groupBy("_t").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in values)).collect()}
    system = np.diag([float(by_time[t]["n"]) for t in range(len(periods))])
    for r in products:
        system[r["i"], r["j"]] -= r["v"]
    target = np.array([[by_time[t][c] for c in values] for t in range(len(periods))])
    effect = np.zeros_like(target)  # the first period's is zero
    effect[1:] = np.linalg.lstsq(system[1:, 1:], target[1:], rcond=None)[0]
    label = np.arange(len(periods))
    for _ in periods:
        for r in products:
            label[r["i"]] = label[r["j"]] = min(label[r["i"]], label[r["j"]])
        if all(label[r["i"]] == label[r["j"]] for r in products):
            break
    rows = [(p, *map(float, e)) for p, e in zip(periods, effect)]
    kind = within.select("_time").schema
    for k in range(len(values)):
        kind = kind.add(f"_e{k}", T.DoubleType())
    return F.broadcast(spark.createDataFrame(rows, kind)), len(set(label.tolist()))


def _iterated_effects(within: DataFrame, values: Sequence[str], tolerance: float = 1e-12, turns: int = 2000) -> DataFrame:
    """As ``_dense_effects``, by conjugate gradients: the system is never formed. Its product with a
    direction takes the direction's mean within each entity off and sums what is left by period. All vectors
    are tables of a row per period; the driver holds three numbers for each of ``values``."""
    each = range(len(values))
    cells = cut(within.groupBy("_i", "_time").agg(F.count("*").cast("double").alias("c")))
    start = within.groupBy("_time").agg(F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"r{k}") for k, c in enumerate(values)))
    state = cut(start.select("*", *(F.lit(0.0).alias(f"_e{k}") for k in each), *((F.col(f"r{k}") / F.col("n")).alias(f"p{k}") for k in each)))
    size = lambda df: [v or 0.0 for v in df.agg(*(F.sum(F.col(f"r{k}") * F.col(f"r{k}") / F.col("n")) for k in each)).first()]
    first = now = size(state)
    own = W.partitionBy("_i")
    for _ in range(turns):
        todo = [k for k in each if now[k] > tolerance * tolerance * first[k]]
        if not todo:
            break
        spread = cells.join(state.select("_time", *(f"p{k}" for k in each)), "_time")
        mean = lambda k: F.sum(F.col("c") * F.col(f"p{k}")).over(own) / F.sum("c").over(own)
        product = spread.select("_time", *((F.col("c") * (F.col(f"p{k}") - mean(k))).alias(f"q{k}") for k in each)).groupBy("_time").agg(*(F.sum(f"q{k}").alias(f"q{k}") for k in each))
        both = cut(state.join(product, "_time"))
        along = both.agg(*(F.sum(F.col(f"p{k}") * F.col(f"q{k}")) for k in each)).first()
        step = [now[k] / along[k] if k in todo and along[k] > 0 else 0.0 for k in each]
        moved = both.select(
            "_time", "n", *((F.col(f"_e{k}") + step[k] * F.col(f"p{k}")).alias(f"_e{k}") for k in each), *((F.col(f"r{k}") - step[k] * F.col(f"q{k}")).alias(f"r{k}") for k in each), *(f"p{k}" for k in each)
        )
        later = size(moved)
        turn = [later[k] / now[k] if step[k] else 0.0 for k in each]
        state = moved.select("_time", "n", *(f"_e{k}" for k in each), *(f"r{k}" for k in each), *((F.col(f"r{k}") / F.col("n") + turn[k] * F.col(f"p{k}")).alias(f"p{k}") for k in each))
        stuck = all(step[k] == 0.0 for k in todo)
        now = [later[k] if step[k] else 0.0 for k in each]
        if stuck:
            break
    return state.select("_time", *(f"_e{k}" for k in each))


def _parts(within: DataFrame) -> int:
    """How many parts a panel falls into that share no entity and no period: labels go from periods to
    entities and back, the smallest first, until none changes."""
    pairs = cut(within.select("_i", "_time").distinct())
    labels, seen = cut(pairs.select("_time").distinct().withColumn("label", F.xxhash64("_time"))), None
    while True:
        sums = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count_distinct("label")).first()
        if sums == seen:
            return sums[1]
        seen = sums
        low = pairs.join(labels, "_time").groupBy("_i").agg(F.min("label").alias("label"))
        labels = cut(pairs.join(low, "_i").groupBy("_time").agg(F.min("label").alias("label")))


#: Periods whose square matrix the driver holds, 8 MB; more are solved by conjugate gradients over tables.
DENSE_PERIODS = 1000


def two_way_fe(df: DataFrame, y: str, x: Sequence[str], entity: str, time: str, dense_periods: int = DENSE_PERIODS, fit: bool = True) -> dict:
    """Entity and time effects by partialling out, exact for unbalanced panels, entity-clustered errors.

    Outcome and regressors are demeaned by entity; their time effects solve one system of periods by
    periods, on the driver up to ``dense_periods`` and by conjugate gradients beyond. What is left is
    regressed by ``ols``. ``degenerate`` tells that the outcome never varies within an entity.

    ``pooled`` are the terms without effects. ``r2_within`` is the share of the variation within entities that
    the regressors explain; ``f_pooled``, on ``df_num`` and ``df_den``, tests that all effects are equal, and
    ``poolability_p`` is its tail. They are None where the outcome is degenerate or no degrees are left, and
    are not made without ``fit``.
    """
    rows = df.dropna(subset=[y, *x, entity, time]).select(F.col(entity).alias("_i"), F.col(time).alias("_time"), F.col(y).cast("double").alias("_out"), *(F.col(c).cast("double").alias(c) for c in x))
    found = rows.select("_time").distinct().orderBy("_time").limit(dense_periods + 1).collect()
    if not found:
        return {"degenerate": True, "terms": [], "periods": 0, "entities": 0, "pooled": [], "r2_within": None, "f_pooled": None, "df_num": None, "df_den": None, "poolability_p": None}
    values = ["_out", *x]
    within = demean(rows, values, "_i")
    if len(found) <= dense_periods:
        periods = len(found)
        effects, parts = _dense_effects(within, values, [r[0] for r in found])
    else:
        periods = rows.select("_time").distinct().count()
        effects, parts = _iterated_effects(within, values), _parts(within)
    own = W.partitionBy("_i")
    net = within.join(effects, "_time")
    net = net.select("_i", *((F.col(c) - (F.col(f"_e{k}") - F.avg(f"_e{k}").over(own))).alias(c) for k, c in enumerate(values)))
    terms = ols(net, "_out", x, cluster="_i", intercept=False, absorbed=periods - 1)
    pooled = ols(rows, "_out", x, cluster="_i") if fit else []
    rest = F.col("_out") - sum((F.col(t["term"]) * t["coef"] for t in terms), F.lit(0.0))
    spread = within.agg(F.count("*").alias("n"), F.count_distinct("_i").alias("g"), F.sum(F.col("_out") * F.col("_out")).alias("all"), F.sum(rest * rest).alias("rest")).first()
    out = {"degenerate": (spread["all"] or 0.0) < 1e-18, "terms": terms, "periods": periods, "entities": spread["g"], "pooled": pooled}
    effects_rank = spread["g"] + periods - parts
    out |= {"r2_within": None, "f_pooled": None, "df_num": effects_rank - 1, "df_den": spread["n"] - len(x) - effects_rank, "poolability_p": None}
    if terms and pooled and not out["degenerate"]:
        out["r2_within"] = 1 - spread["rest"] / spread["all"]
        if out["df_num"] > 0 and out["df_den"] > 0 and terms[0]["rss"] > 0:
            out["f_pooled"] = (pooled[0]["rss"] - terms[0]["rss"]) / out["df_num"] / (terms[0]["rss"] / out["df_den"])
            out["poolability_p"] = special.f_upper(max(out["f_pooled"], 0.0), out["df_num"], out["df_den"])
    return out


def logit(df: DataFrame, y: str, x: Sequence[str], steps: int = 25, cluster: str | None = None) -> list[dict]:
    """Maximum likelihood by Newton's steps, each one pass of grouped sums; z tests. Columns are
    standardised for the steps and coefficients given in their own units.

    With ``cluster`` errors are robust to it: the scores at the maximum are summed per cluster, the
    driver gets the sum of their outer products, and the factor is that of ``ols``. One cluster alone has no
    errors."""
    group = [F.col(cluster).alias("_g")] if cluster else []
    rows = df.dropna(subset=[y, *x, *([cluster] if cluster else [])]).select(F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in x), *group)
    scale = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    if not scale["n"]:
        return []
    means, devs = [scale[f"m{i}"] for i in range(len(x))], [scale[f"s{i}"] or 1.0 for i in range(len(x))]
    cols = [F.lit(1.0), *((F.col(c) - m) / s for c, m, s in zip(x, means, devs))]
    k = len(cols)
    beta, hess = np.zeros(k), np.eye(k)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((c * float(b) for c, b in zip(cols, beta)), F.lit(0.0))))
        w = p * (1 - p)
        r = rows.agg(*(F.sum(c * (F.col("_y") - p)).alias(f"g{i}") for i, c in enumerate(cols)), *(F.sum(cols[i] * cols[j] * w).alias(f"h{i}_{j}") for i, j in pairs)).first()
        for i, j in pairs:
            hess[i, j] = hess[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.pinv(hess) @ np.array([r[f"g{i}"] for i in range(k)])
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    back = np.eye(k)
    for i, (m, s) in enumerate(zip(means, devs), 1):
        back[i, i] = 1 / s
        back[0, i] = -m / s
    bread, groups = np.linalg.pinv(hess), None
    cov = bread
    if cluster:
        p = 1 / (1 + F.exp(-sum((c * float(b) for c, b in zip(cols, beta)), F.lit(0.0))))
        scored = rows.groupBy("_g").agg(*(F.sum(c * (F.col("_y") - p)).alias(f"u{i}") for i, c in enumerate(cols)))
        r = scored.agg(F.count("*").alias("g"), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs)).first()
        meat, groups = np.zeros((k, k)), r["g"]
        for i, j in pairs:
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
        n = scale["n"]
        cov = bread @ meat @ bread * (groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else math.nan)
    coef, cov = back @ beta, back @ cov @ back.T
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    return [
        {"term": t, "coef": float(b), "se": float(s), "z": float(b / s) if s > 0 else None, "p": special.normal_two_sided(b / s) if s > 0 else None, "n": scale["n"], "clusters": groups}
        for t, b, s in zip(["const", *x], coef, se)
    ]


def winsorize(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``value`` clipped to its exact global quantiles."""
    q = quantiles(df, value, (low, high))
    return df if q is None else df.withColumn(value, F.greatest(F.least(F.col(value), F.lit(q[1])), F.lit(q[0])))


def extreme_tail(df: DataFrame, value: str, low: float = 0.1, high: float = 0.9, flag: str = "extreme") -> DataFrame:
    """``flag``: at or beyond the exact global quantiles."""
    q = quantiles(df, value, (low, high)) or (0.0, 0.0)
    return df.withColumn(flag, (F.col(value) <= q[0]) | (F.col(value) >= q[1]))


def leave_one_out(df: DataFrame, y: str, x: Sequence[str], group: str) -> DataFrame:
    """``(group, term, coef)`` of least squares without each group's rows: the groups' cross products
    are summed once and taken off the total, a small solve per group inside the tasks."""
    names = ["_const", *x]
    rows = df.dropna(subset=[y, *x, group]).select(F.col(group).alias("_g"), F.lit(1.0).alias("_const"), *(F.col(c).cast("double").alias(c) for c in x), F.col(y).cast("double").alias("_y"))
    k = len(names)
    pairs = [(names[i], names[j]) for i in range(k) for j in range(k)] + [(c, "_y") for c in names]
    sums = F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs)).alias("s")
    total = rows.agg(sums).first()["s"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = np.array(total)[None, :] - np.array(b.column("s").to_pylist())
            coefs = np.stack([np.linalg.pinv(v[: k * k].reshape(k, k)) @ v[k * k :] for v in left])
            yield pa.RecordBatch.from_arrays([b.column("_g"), pa.array(coefs.tolist())], ["_g", "coefs"])

    per = rows.groupBy("_g").agg(sums)
    found = per.mapInArrow(solve, f"_g {per.schema['_g'].dataType.simpleString()}, coefs array<double>")
    terms = F.arrays_zip(F.array(*(F.lit("const" if c == "_const" else c) for c in names)).alias("term"), F.col("coefs").alias("coef"))
    return found.select(F.col("_g").alias(group), F.explode(terms).alias("e")).select(group, "e.term", "e.coef")


def collapse(df: DataFrame, entity: str, values: Sequence[str], how: str = "mean") -> DataFrame:
    """One row an entity: ``mean`` or ``median`` of each value, and ``n_rows``."""
    each = {"mean": F.avg, "median": F.median}[how]
    return df.groupBy(entity).agg(*(each(c).alias(c) for c in values), F.count("*").alias("n_rows"))


def specifications(cuts: dict[str, DataFrame], outcome: str, predictor: str, specs: dict[str, Sequence[str]], cluster: str, min_rows: int = 20, min_clusters: int = 5) -> list[dict]:
    """``(scenario, controls, n, coef, p_value)`` of clustered least squares for each cut and list of
    controls, with nulls where rows or clusters are too few. All cells are found in the same two passes."""
    needed = list(dict.fromkeys([outcome, predictor, cluster, *(c for cs in specs.values() for c in cs)]))
    tagged = [df.select(F.lit(name).alias("_cut"), *needed) for name, df in cuts.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    cells = ols_many(rows, {spec: (outcome, [predictor, *controls]) for spec, controls in specs.items()}, cluster, "_cut")
    out = []
    for scenario in cuts:
        for spec in specs:
            cell = cells.get((scenario, spec), {"n": 0, "clusters": 0, "terms": []})
            row = {"scenario": scenario, "controls": spec, "n": cell["n"], "coef": None, "p_value": None}
            term = next((r for r in cell["terms"] if r["term"] == predictor), None)
            if term and cell["n"] >= min_rows and cell["clusters"] >= min_clusters:
                row |= {"coef": term["coef"], "p_value": term["p"]}
            out.append(row)
    return out


def flips(results: DataFrame, first: str, second: str, level: float = 0.05) -> DataFrame:
    """``(scenario, p_first, p_second)`` where the second specification is below ``level`` and the first isn't."""
    p = lambda spec: F.max(F.when(F.col("controls") == spec, F.col("p_value")))
    wide = results.groupBy("scenario").agg(p(first).alias("p_first"), p(second).alias("p_second"))
    return wide.where((F.col("p_first") >= level) & (F.col("p_second") < level))


def panel_battery(
    df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], controls: Sequence[str], entity: str, time: str, sector: Sequence[str] = (),
    drop_controls: dict[str, Sequence[str]] | None = None, min_rows: int = 20, min_clusters: int = 10,
) -> list[dict]:
    """Per outcome and predictor five p values (correlation, clustered alone, with controls, with
    sector dummies too, two-way effects) and the least of them. ``sector`` names dummy columns;
    ``drop_controls`` names controls that an outcome is made of. Correlations of all pairs are one
    aggregation, their regressions two."""
    names = list(dict.fromkeys([*outcomes, *predictors, *controls, *sector, entity, time]))
    df = cut(df.select(*names))
    pairs = [(y, x) for y in outcomes for x in predictors]
    own = {y: [c for c in controls if c not in (drop_controls or {}).get(y, ())] for y in outcomes}
    both = [F.col(y).isNotNull() & F.col(x).isNotNull() for y, x in pairs]
    simple = df.agg(*(c for k, (y, x) in enumerate(pairs) for c in (F.count_if(both[k]).alias(f"n{k}"), F.corr(F.when(both[k], F.col(x)), F.when(both[k], F.col(y))).alias(f"r{k}")))).first()
    models = {}
    for y, x in pairs:
        for spec, more in (("alone", []), ("controls", own[y]), ("sector", [*own[y], *sector])):
            models[f"{y} {x} {spec}"] = (y, [x, *more])
    cells = ols_many(df, models, entity)
    out = []
    for k, (y, x) in enumerate(pairs):
        if simple[f"n{k}"] < min_rows:
            continue
        found = {}
        for spec in ("alone", "controls", "sector"):
            cell = cells.get((0, f"{y} {x} {spec}"), {"n": 0, "clusters": 0, "terms": []})
            enough = cell["n"] >= min_rows and cell["clusters"] >= min_clusters
            found[spec] = next((t["p"] for t in cell["terms"] if t["term"] == x), None) if enough else None
        panel = df.dropna(subset=[y, x, *own[y]])
        size = panel.agg(F.count("*").alias("n"), F.count_distinct(entity).alias("g"), F.count_distinct(time).alias("t")).first()
        fe = None
        if size["n"] >= 30 and size["g"] >= 10 and size["t"] >= 2:
            effects = two_way_fe(panel, y, [x, *own[y]], entity, time, fit=False)
            fe = None if effects["degenerate"] else next((t["p"] for t in effects["terms"] if t["term"] == x), None)
        ps = [correlation_p(simple[f"n{k}"], simple[f"r{k}"]), *found.values(), fe]
        out.append({
            "outcome": y, "predictor": x, "n": simple[f"n{k}"], "r": simple[f"r{k}"], "p_simple": ps[0], "p_clustered": ps[1], "p_controls": ps[2], "p_sector": ps[3], "p_fe": ps[4],
            "p_least": min((p for p in ps if p is not None), default=None),
        })
    return out


def battery(
    df: DataFrame, label: str, outcome: str, predictor: str, cluster: str, controls: Sequence[str] = (), group: str | None = None,
    min_rows: int = 20, min_each: int = 5, least: int = 10,
) -> list[dict]:
    """Up to eight tests of one cut, each behind its coverage gate: correlations of the signed and the
    absolute outcome, clustered least squares without and with controls, Kruskal-Wallis over the
    predictor's terciles, and for a 0/1 ``group`` its rank test and clustered regression."""
    out: list[dict] = []
    needed = list(dict.fromkeys([outcome, predictor, cluster, *controls, *([group] if group else [])]))
    have = cut(df.dropna(subset=[outcome, predictor]).select(*needed))
    size = have.agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("g")).first()

    def add(test: str, stat: float | None, p: float | None, note: str = "", n: int | None = None) -> None:
        out.append({"label": label, "test": test, "n": size["n"] if n is None else n, "clusters": size["g"], "stat": stat, "p_value": p, "note": note})

    if size["n"] < least:
        add("coverage_too_low", None, None)
        return out
    r = have.agg(F.corr(predictor, outcome).alias("signed"), F.corr(predictor, F.abs(outcome)).alias("size")).first()
    ranks = spearman(have, predictor, outcome).first()
    add("signed_pearson", r["signed"], correlation_p(size["n"], r["signed"]))
    add("signed_spearman", ranks["r"], ranks["p"])
    add("magnitude_pearson", r["size"], correlation_p(size["n"], r["size"]))
    models = {"alone": (outcome, [predictor])} | ({"controls": (outcome, [predictor, *controls])} if controls else {}) | ({"group": (outcome, [group])} if group else {})
    fits = ols_many(have, models, cluster)
    term = lambda model, name: next((t for t in fits.get((0, model), {"terms": []})["terms"] if t["term"] == name), None)
    if t := term("alone", predictor):
        add("clustered_ols_no_controls", t["coef"], t["p"])
    if controls and (t := term("controls", predictor)) and t["n"] >= min_rows:
        add("clustered_ols_with_controls", t["coef"], t["p"], n=t["n"])
    edges = quantiles(have, predictor, (0, 1 / 3, 2 / 3, 1))
    if len(set(edges)) == 4:
        thirds = have.withColumn("_third", (F.col(predictor) > edges[1]).cast("int") + (F.col(predictor) > edges[2]).cast("int"))
        k = kruskal(thirds, outcome, "_third").first()
        means = {r["_third"]: r["m"] for r in thirds.groupBy("_third").agg(F.avg(outcome).alias("m")).collect()}
        add("tercile_kruskal", k["h"], k["p"], " ".join(f"{n}={means.get(i, math.nan):+.4f}" for i, n in enumerate(("low", "mid", "high"))))
    if group:
        sides = {r[group]: r for r in have.where(F.col(group).isin(0, 1)).groupBy(group).agg(F.count("*").alias("n"), F.avg(outcome).alias("m")).collect()}
        if len(sides) == 2 and min(s["n"] for s in sides.values()) >= min_each:
            add("group_mann_whitney", sides[1]["m"] - sides[0]["m"], mann_whitney(have, outcome, group).first()["p"])
            if t := term("group", group):
                add("group_clustered", t["coef"], t["p"])
    return out
