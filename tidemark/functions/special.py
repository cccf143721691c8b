"""Tail probabilities of the normal, t, F, chi-squared and rank-sum distributions, without further libraries."""

from __future__ import annotations

import functools
import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_lower(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, k: float) -> float:
    """Regularised upper incomplete gamma at ``(k / 2, x / 2)``."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d, c = 1 / (num * d + b), b + num / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@functools.lru_cache(maxsize=32)
def rank_sum_counts(n1: int, n0: int) -> tuple[int, ...]:
    """How many choices of ``n1`` among ``n1 + n0`` ranks have each U, 0 to ``n1 * n0``: the coefficients of
    the product of ``(1 - q ** (n0 + i)) / (1 - q ** i)`` over ``i`` to ``n1``."""
    n1, n0 = sorted((n1, n0))
    counts = [1] + [0] * (n1 * n0)
    for i in range(1, n1 + 1):
        for u in range(len(counts) - 1, n0 + i - 1, -1):
            counts[u] -= counts[u - n0 - i]
        for u in range(i, len(counts)):
            counts[u] += counts[u - i]
    return tuple(counts)


def rank_sum_tail(u: float, n1: int, n0: int, side: str = "two-sided") -> float:
    """Exact p of U without ties; two-sided is twice the smaller tail, 1 at most."""
    counts = rank_sum_counts(n1, n0)
    total, at = sum(counts), round(u)
    less, greater = sum(counts[: at + 1]) / total, sum(counts[at:]) / total
    return {"less": less, "greater": greater, "two-sided": min(1.0, 2 * min(less, greater))}[side]
