"""Tail probabilities without SciPy: regularised incomplete beta, Student's t and the normal law."""

from __future__ import annotations

import math

#: 97.5 % point of the standard normal law.
Z975 = 1.959963984540054


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` of ``n`` points under Student's t with n - 2 degrees."""
    if r is None or n < 3:
        return None
    if n == 3 and abs(r) >= 1 or abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_inc(df / 2, 0.5, df / (df + t2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
