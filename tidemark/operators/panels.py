"""Feature builders: universes, filing dates, account panels, controls, ratios and composition panels.

Each is one aggregation by entity and period where the inputs allow it: a cell is a conditional
aggregate, so consolidated and individual statements, or the bodies of a company, need no joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .relational import first_by, latest_version, row_sum, share_of
from .timeseries import asof_backward


def universe(index: DataFrame, register: DataFrame, entity: str, period: str, version: str, sector: str, excluded: Column, chosen: Column, *ties: str) -> DataFrame:
    """The latest version of each entity's filing of a period, among ``chosen`` filings of entities whose
    first entry in ``register`` is known, with its ``sector``; entities with an ``excluded`` entry only go."""
    allowed = register.where(~F.coalesce(excluded, F.lit(False))).select(entity).distinct()
    sectors = register.groupBy(entity).agg(F.min(sector).alias(sector))
    filed = index.where(F.coalesce(chosen, F.lit(False))).join(allowed, entity, "left_semi")
    return latest_version(filed, [entity, period], version, *ties).join(sectors, entity, "left")


def quarterly_universe(index: DataFrame, register: DataFrame, entity: str, period: str, version: str, sector: str, excluded: Column, chosen: Column, *ties: str) -> DataFrame:
    """``universe`` of periods that end with one of the first three quarters, with their ``quarter`` label."""
    quarters = index.where(scalars.quarter_end(F.col(period)))
    return universe(quarters, register, entity, period, version, sector, excluded, chosen, *ties).withColumn("quarter", scalars.period_label(F.col(period)))


def filing_dates(logs: dict[str, DataFrame], index: DataFrame, keys: Sequence[str], matched: str, document: str) -> DataFrame:
    """Downloads with at least one match and a known document, each with its log's name as ``source``
    and the columns of ``index`` for ``keys``; nulls where the index lacks them."""
    parts = [log.where((F.col(matched) > 0) & F.col(document).isNotNull()).withColumn("source", F.lit(name)) for name, log in logs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(index, list(keys), "left")


def current_period(rows: DataFrame, tag: str) -> DataFrame:
    """The rows of the current period; an error if there are rows and none is."""
    kept = rows.where(scalars.latest_period(F.col(tag)))
    if kept.isEmpty() and not rows.isEmpty():
        raise ValueError(f"no tag of the current period in {tag}")
    return kept


def accounts(rows: DataFrame, keys: Sequence[str], code: str, value: str, basis: str, order: Sequence[str], names: dict[str, str], prefer: Sequence[str] = ("con", "ind")) -> DataFrame:
    """A row per key with a column per account: its first non-null value by ``order`` in the first
    basis of ``prefer`` that has one."""
    at = F.struct(*order)

    def cell(account: str) -> Column:
        hit = lambda b: (F.col(code) == account) & (F.col(basis) == b) & F.col(value).isNotNull()
        return F.coalesce(*(F.min_by(value, F.when(hit(b), at)) for b in prefer))

    return rows.where(F.col(code).isin(*names)).groupBy(*keys).agg(*(cell(a).alias(n) for a, n in names.items()))


def control_variables(wide: DataFrame) -> DataFrame:
    """Liabilities, leverage, returns on assets and equity, and logarithms of assets and revenue (raised
    to 1). Rows whose assets are exactly zero are unfilled forms and go; others with nulls stay."""
    out = wide.where(F.col("total_assets").isNull() | (F.col("total_assets") != 0))
    out = out.withColumn("total_liabilities", F.col("current_liabilities") + F.col("noncurrent_liabilities"))
    return out.withColumns({
        "leverage": F.try_divide("total_liabilities", "total_assets"), "roa": F.try_divide("net_income", "total_assets"), "roe": F.try_divide("net_income", "total_equity"),
        "ln_total_assets": scalars.log_at_least(F.col("total_assets")), "ln_net_revenue": scalars.log_at_least(F.col("net_revenue")),
    })


def extended_controls(wide: DataFrame) -> DataFrame:
    """As ``control_variables``, but liabilities are known if one part is, only positive assets have a
    logarithm, and the cost of debt is there."""
    out = wide.withColumn("total_liabilities", row_sum(["current_liabilities", "noncurrent_liabilities"], 1))
    return out.withColumns({
        "leverage": F.try_divide("total_liabilities", "total_assets"), "roa": F.try_divide("net_income", "total_assets"),
        "ln_total_assets": scalars.log_if_positive(F.col("total_assets")), "cost_of_debt": cost_of_debt(F.col("financial_expense"), F.col("total_liabilities")),
    })


def cost_of_debt(expense: Column, liabilities: Column) -> Column:
    """Size of the financial expense over liabilities."""
    return F.try_divide(F.abs(expense), liabilities)


def year_end_prices(prices: DataFrame, years: DataFrame, key: str, at: str, price: str) -> DataFrame:
    """``(key, year, price)`` on the last day up to each year's end on which any key has a price; keys
    without a price on that very day have no row."""
    days = prices.where(F.col(price).isNotNull()).select(F.col(at)).distinct().withColumn("_one", F.lit(1)).withColumn("_day", F.col(at))
    ends = years.select("year", F.make_date("year", F.lit(12), F.lit(31)).cast(prices.schema[at].dataType).alias(at), F.lit(1).alias("_one"))
    spine = asof_backward(ends, days, "_one", at, ["_day"]).select("year", F.col("_day").alias(at))
    return prices.where(F.col(price).isNotNull()).join(F.broadcast(spine.where(F.col(at).isNotNull())), at).select(key, "year", price)


def market_to_book(year_ends: DataFrame, shares: DataFrame, equity: DataFrame, key: str, price: str, parts: Sequence[str], *ties: str) -> DataFrame:
    """``(key, year, total_shares, market_cap, market_to_book)``: price times the sum of share classes,
    of the first positive entry of a key and year, over book equity (null where that is 0 or unknown)."""
    counted = shares.withColumn("total_shares", row_sum(parts)).where(F.col("total_shares") > 0)
    single = first_by(counted, [key, "year"], [F.col(t) for t in ties]).select(key, "year", "total_shares")
    valued = year_ends.join(single, [key, "year"]).withColumn("market_cap", F.col(price) * F.col("total_shares"))
    book = valued.join(equity.select(key, "year", "total_equity"), [key, "year"], "left")
    return book.select(key, "year", "total_shares", "market_cap", F.try_divide("market_cap", "total_equity").alias("market_to_book"))


def composition_panel(rows: DataFrame, keys: Sequence[str], body: str, bodies: dict[str, str], shares: dict[str, tuple[Sequence[str], Sequence[str]]], size: tuple[str, str]) -> DataFrame:
    """Per key the share of some counts in others, for each body: ``<share>_<name>`` with a flag
    ``has_<share>_<name>`` (unknown counts as none) and ``<name>_size``, the sum of the whole of the first
    share. Keys whose ``size`` body (its name, and the column to hold above 0) is empty go."""
    counts = sorted({c for parts in shares.values() for side in parts for c in side})
    summed = rows.groupBy(*keys).agg(*(F.sum(F.when(F.col(body) == b, F.col(c))).alias(f"_{n}_{c}") for n, b in bodies.items() for c in counts))
    out = {}
    for n in bodies:
        for i, (share, (part, whole)) in enumerate(shares.items()):
            named = lambda cs: [f"_{n}_{c}" for c in cs]  # noqa: B023, E731
            out[f"{share}_{n}"] = share_of(named(part), named(whole))
            out[f"has_{share}_{n}"] = F.coalesce(out[f"{share}_{n}"] > 0, F.lit(False))
            if i == 0:
                out[f"{n}_size"] = row_sum(named(whole))
    return summed.withColumns(out).where(F.col(f"{size[0]}_size") > 0).select(*keys, *out)
