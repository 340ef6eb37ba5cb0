"""Small numeric helpers: the chi-square distribution without further libraries."""

from __future__ import annotations

import math


def chi_square_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma function by its power series."""
    if x <= 0:
        return 0.0
    a, y = df / 2, x / 2
    if y > a + 60 * math.sqrt(a + 1) + 60:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi_square_quantile(p: float, df: int) -> float:
    """The x with distribution value ``p``, by bisection."""
    low, high = 0.0, df + 10.0
    while chi_square_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2
