"""Column functions that Spark lacks or whose edge cases must be pinned down."""

from __future__ import annotations

import math
import operator
from functools import cache, reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.when(F.isnan(x), None).otherwise(x)


def finite(x: Column) -> Column:
    """NaN and infinite values become null."""
    return F.when(F.abs(x) < float("inf"), x)


def exchange_of(ticker: Column) -> Column:
    """The last token: 'BARC LN' gives LN; a single token is itself."""
    return F.element_at(F.split(F.trim(ticker), r"\s+"), -1)


def ratio_return(now: Column, before: Column) -> Column:
    """now / before - 1; null where before is 0."""
    return F.try_divide(now, before) - 1


def clipped(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(x: Column, centre: Column, steepness: Column) -> Column:
    """The logistic function, its exponent kept within 500."""
    z = clipped(steepness * (x - centre), -500.0, 500.0)
    return 1 / (1 + F.exp(-z))


def severity(delta: Column) -> Column:
    """1 - 1 / (1 + exp(delta)), 1 for large delta."""
    return 1 - 1 / (1 + F.exp(clipped(delta, -700.0, 700.0)))


def half_even(x: Column, digits: int = 2) -> Column:
    return F.bround(x, digits)


#: Points of the Gauss-Legendre rule, and the deviations of the integrand (about 1 / sqrt(dof) each) that it covers:
#: what is beyond 9 of them is under 1e-17 of the whole.
POINTS, DEVIATIONS = 24, 9.0
#: Coefficients of gamma(x) / gamma(x + 1/2) * sqrt(x) in powers of 1 / x, and by how much x is raised before they are
#: used, so that what is left out is under 1e-10 (fixed values).
RATIO, RAISED = (1.0, 1 / 8, 1 / 128, -5 / 1024, -21 / 32768, 399 / 262144, 869 / 4194304), 8


@cache
def gauss_legendre() -> tuple[tuple[float, float], ...]:
    """(point, weight) on 0..1."""
    x, w = np.polynomial.legendre.leggauss(POINTS)
    return tuple(zip(((x + 1) / 2).tolist(), (w / 2).tolist()))


def t_angle(t: Column, dof: Column) -> Column:
    return F.atan(F.abs(t) / F.sqrt(dof))


def student_t_two_sided(angle: Column, dof: Column) -> Column:
    """P(|T| >= |t|) of Student's t with dof >= 2, angle being t_angle(t, dof): the integral of cos ** (dof - 1) from the
    angle on, over that from 0 on, which has a closed form.

    angle and dof occur in every term. They are bound once, as an array's only element: as plain columns the optimizer
    would put what they stand for into each term, which is more than a generated method can hold.
    """

    def p(x: Column) -> Column:
        angle, dof = x["angle"], x["dof"]
        length = F.least(F.lit(math.pi / 2) - angle, DEVIATIONS / F.sqrt(dof))
        tail = reduce(operator.add, [w * F.pow(F.cos(angle + length * at), dof - 1) for at, w in gauss_legendre()]) * length
        half = dof / 2
        raised = half + RAISED
        series = reduce(lambda s, c: s / raised + c, [F.lit(c) for c in reversed(RATIO)]) / F.sqrt(raised)
        rising = reduce(operator.mul, [(half + k + 0.5) / (half + k) for k in range(RAISED)])
        return tail / (math.sqrt(math.pi) / 2 * series * rising)

    return F.transform(F.array(F.struct(angle.alias("angle"), dof.alias("dof"))), p)[0]


def least_t(alpha: float) -> float:
    """|t| below which no number of degrees of freedom gives a two-sided p under alpha: the normal quantile."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def two_sided_p(t: float, dof: float) -> float:
    """student_t_two_sided() of numbers."""
    angle = math.atan(abs(t) / math.sqrt(dof))
    length = min(math.pi / 2 - angle, DEVIATIONS / math.sqrt(dof))
    tail = length * sum(w * math.cos(angle + length * at) ** (dof - 1) for at, w in gauss_legendre())
    return tail / (math.sqrt(math.pi) / 2 * math.exp(math.lgamma(dof / 2) - math.lgamma(dof / 2 + 0.5)))


@cache
def t_bounds(alpha: float, least_dof: float, most_dof: float) -> tuple[float, float]:
    """(low, high): with degrees of freedom between these, p isn't under alpha where |t| < low, and it is where |t| >= high.
    Both keep a millionth away from where p is alpha, which is far more than p is off by."""
    if least_dof < 2 or not 0 < alpha < 1:
        return least_t(alpha), math.inf

    def quantile(dof: float) -> float:
        low, high = 0.0, 1.0
        while two_sided_p(high, dof) > alpha:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if two_sided_p(middle, dof) > alpha else (low, middle)
        return high

    return quantile(most_dof) * (1 - 1e-6), quantile(least_dof) * (1 + 1e-6)


def welch(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column, n: int) -> tuple[Column, Column]:
    """t and degrees of freedom for two samples of n values each; null if both variances are 0."""
    a, b = var_a / n, var_b / n
    t = F.try_divide(mean_a - mean_b, F.sqrt(a + b))
    return t, F.try_divide((a + b) * (a + b), (a * a + b * b) / (n - 1))
