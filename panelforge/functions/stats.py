"""Tail probabilities computed on the driver: one value for each model or group."""

from __future__ import annotations

import math


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    lead = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - lead * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def binomial_two_sided(wins: int, n: int) -> float:
    """Exact two-sided p-value of ``wins`` of ``n`` at probability one half."""
    if n == 0:
        return 1.0
    k = min(wins, n - wins)
    total = sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
        for i in range(k + 1)
    )
    return min(1.0, 2 * total)
