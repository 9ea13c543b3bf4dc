"""Upper-tail probabilities of the t, F and chi-square distributions.

They are evaluated on the driver for a handful of already aggregated
statistics. The regularised incomplete beta function uses its continued
fraction, the incomplete gamma function its power series or continued fraction
(Abramowitz & Stegun 26.5.8, 6.5.29 and 6.5.31).
"""

from __future__ import annotations

import math

_TINY = 1e-300
_EPS = 1e-16
# Parameters from which asymptotic forms are used, and the error they may have.
_LARGE, _LARGE_ERROR = 1e5, 1e-9


def _continued_fraction(numerators, denominators, limit: int = 2_000_000) -> float:
    """b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz scheme."""
    value = denominators(0) or _TINY
    c, d = value, 0.0
    for i in range(1, limit):
        a, b = numerators(i), denominators(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS * 4:
            return value
    raise ArithmeticError("the continued fraction of a tail probability does not converge")


def incomplete_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b).

    ``rest`` is 1 - x, for callers that know it more exactly than x near 1 tells.
    Where ``a`` outweighs ``b`` by far, the gamma limit in -ln x is exact to about
    b^3 / a^2.
    """
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if a > _LARGE and b ** 3 < _LARGE_ERROR * a * a:
        return incomplete_gamma_upper(b, -(a + (b - 1.0) / 2.0) * math.log1p(-rest))
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, rest, x)

    def numerator(i: int) -> float:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * (math.log(x) if x < 0.5 else math.log1p(-rest)) + b * math.log(rest)
    )
    return math.exp(front) / a / _continued_fraction(numerator, lambda i: 1.0)


def incomplete_gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if a > _LARGE:
        return _large_gamma_upper(a, x)
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    fraction = _continued_fraction(
        lambda i: -(i - 1) * (i - 1 - a) if i > 1 else 1.0,
        lambda i: 0.0 if i == 0 else x + 2 * i - 1 - a,
    )
    return min(1.0, front * fraction)


def _large_gamma_upper(a: float, x: float) -> float:
    """Q(a, x) by Temme's uniform expansion (DLMF 8.12.4), first term; relative to 1/a."""
    mu = (x - a) / a
    if abs(mu) < 1e-3:
        half_square = mu * mu * (0.5 - mu / 3 + mu * mu / 4 - mu ** 3 / 5)
    else:
        half_square = mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(2.0 * half_square), mu)
    bend = -1.0 / 3.0 + mu / 12.0 if abs(mu) < 1e-4 else 1.0 / mu - 1.0 / eta
    density = math.exp(-a * half_square) / math.sqrt(2.0 * math.pi * a)
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + density * bend))


def t_two_sided(t: float | None, df: float) -> float | None:
    if t is None or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation coefficient over ``n`` pairs."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)


def f_upper(f: float | None, d1: float, d2: float) -> float | None:
    if f is None or d1 <= 0 or d2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    return incomplete_beta(
        d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def chi2_upper(x: float | None, dof: int) -> float | None:
    if x is None:
        return None
    if dof <= 0:
        return 1.0
    return incomplete_gamma_upper(dof / 2.0, x / 2.0)
