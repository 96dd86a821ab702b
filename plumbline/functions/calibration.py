"""Exact calibration of an alarm threshold on the difference of two binomial counts. Data-independent, in exact integers."""

from __future__ import annotations

from fractions import Fraction
from math import comb, exp, lgamma, log


def tail_at_half(n: int, threshold: int) -> Fraction:
    """P(X - Y >= threshold) for independent counts of n fair trials: X - Y + n is a count of 2n fair trials."""
    return Fraction(sum(comb(2 * n, k) for k in range(n + threshold, 2 * n + 1)), 4**n)


def alarm_threshold(n: int = 100, alpha: Fraction = Fraction(1, 20)) -> tuple[int, Fraction]:
    """The smallest positive difference whose false-alarm probability is below ``alpha``."""
    for d in range(1, n + 1):
        if (p := tail_at_half(n, d)) < alpha:
            return d, p
    raise ValueError("no threshold controls the level")


def binomial_pmf(n: int, p: float) -> list[float]:
    if p in (0.0, 1.0):
        return [float(k == round(n * p)) for k in range(n + 1)]
    return [exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(n + 1)]


def tail_polynomial(n: int, threshold: int) -> list[Fraction]:
    """Bernstein coefficients (degree 2n) of P(X - Y >= threshold) as a function of the common success rate."""
    degree = 2 * n
    out = []
    for j in range(degree + 1):  # j successes in all; how they fall to the two arms is hypergeometric
        ways = sum(comb(n, x) * comb(n, j - x) for x in range(max(0, j - n), min(n, j) + 1) if x - (j - x) >= threshold)
        out.append(Fraction(ways, comb(degree, j)))
    return out


def rises_to_half(n: int, threshold: int) -> bool:
    """Whether the tail provably rises on [0, 1/2].

    The derivative's Bernstein coefficients are differences of neighbours; de Casteljau's scheme at
    1/2 gives those of the left half, and none of them may be negative.
    """
    b = tail_polynomial(n, threshold)
    d = [y - x for x, y in zip(b, b[1:], strict=False)]
    left = []
    while d:
        left.append(d[0])
        d = [(x + y) / 2 for x, y in zip(d, d[1:], strict=False)]
    return all(x >= 0 for x in left)
