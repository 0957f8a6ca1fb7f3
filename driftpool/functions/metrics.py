"""Accuracy of predictions as mergeable aggregates."""

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2(y: Column | str, p: Column | str) -> Column:
    """1 - SSres/SStot; a constant label gives 1 if predicted exactly, else 0.

    The total comes from a variance that Spark merges without cancellation, so
    the aggregate combines on the map side and needs one pass.
    """
    y, p = _column(y), _column(p)
    residual = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * F.count(y)
    flat = F.min(y) == F.max(y)
    return (F.when(flat & (residual == 0), 1.0).when(flat, 0.0)
            .otherwise(1 - residual / total))


def mse(y: Column | str, p: Column | str) -> Column:
    error = _column(y) - _column(p)
    return F.avg(error * error)


def rmse(y: Column | str, p: Column | str) -> Column:
    return F.sqrt(mse(y, p))


def mae(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(_column(y) - _column(p)))


def pearson(y: Column | str, p: Column | str) -> Column:
    return F.corr(p, y)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1_000_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    else:
        raise ArithmeticError("continued fraction has not converged")
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation; runs on the result rows only."""
    def one(rv, nv):
        if rv is None or pd.isna(rv) or nv < 3:
            return None
        if abs(rv) >= 1.0:
            return 0.0
        free = nv - 2.0
        return incomplete_beta(free / 2.0, 0.5, 1.0 - rv * rv)
    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")
