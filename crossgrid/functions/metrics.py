"""Accuracy aggregates and labelling rules as Column expressions.

Every aggregate is algebraic, so Spark combines map-side and one hot group costs no more
than any other.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pair(y, f) -> tuple[Column, Column]:
    """Both sides of a pair, each NULL where the other one is."""
    y, f = _c(y), _c(f)
    both = y.isNotNull() & f.isNotNull()
    return F.when(both, y), F.when(both, f)


def r2(y, f) -> Column:
    """1 - SSE/SST; NULL where the labels do not vary. May be negative."""
    y, f = _pair(y, f)
    return 1 - F.try_divide(F.avg((y - f) * (y - f)), F.var_pop(y))


def bias(y, f) -> Column:
    return F.avg(_c(f) - _c(y))


def error_std(y, f) -> Column:
    return F.stddev_pop(_c(f) - _c(y))


def mae(y, f) -> Column:
    return F.avg(F.abs(_c(y) - _c(f)))


def rmse(y, f) -> Column:
    return F.sqrt(F.avg((_c(y) - _c(f)) * (_c(y) - _c(f))))


def pearson(x, y) -> Column:
    """Pearson r over complete pairs; NULL where either side does not vary."""
    x, y = _pair(x, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def pearson_t(r, n) -> Column:
    """t statistic of a Pearson r over n pairs."""
    r, n = _c(r), _c(n)
    return F.try_divide(r * F.sqrt(F.greatest(n - 2, F.lit(0)).cast("double")), F.sqrt(1 - r * r))


def recovery(baseline, intervention, donor) -> Column:
    """Share of the donor's advantage that the intervention recovers; not clipped."""
    gap = _c(donor) - _c(baseline)
    return F.when(gap > 0, (_c(intervention) - _c(baseline)) / gap)


def season_group(model_year, model_quarter, eval_year, eval_quarter) -> Column:
    same_year = _c(model_year) == _c(eval_year)
    same_season = _c(model_quarter) == _c(eval_quarter)
    return (
        F.when(same_year & same_season, "diagonal")
        .when(same_season, "same_season_other_year")
        .when(same_year, "other_season_same_year")
        .otherwise("other_season_other_year")
    )


def direction_note(coef, p, expect_positive: bool = True, alpha: float = 0.05) -> Column:
    """Reads one coefficient against the expected sign."""
    coef, p = _c(coef), _c(p)
    as_expected = coef > 0 if expect_positive else coef < 0
    return (
        F.when(coef.isNull() | p.isNull(), "not estimable")
        .when(p >= alpha, "no support")
        .when(as_expected, "consistent")
        .otherwise("opposite")
    )


def effect_label(p, d, alpha: float = 0.05) -> Column:
    """Size of a significant effect by the absolute standardised difference."""
    size = F.abs(_c(d))
    return (
        F.when(_c(p).isNull() | _c(d).isNull(), "insufficient_data")
        .when(_c(p) >= alpha, "not_significant")
        .when(size >= 0.8, "large")
        .when(size >= 0.5, "medium")
        .when(size >= 0.2, "small")
        .otherwise("negligible")
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz recurrence)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    # it converges in some sqrt(max(a, b)) steps; the bound only ends a last digit that wavers
    for m in range(1, 400 + int(20 * math.sqrt(max(a, b)))):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-values; only ever applied to aggregated rows."""
    return pd.Series([
        None if pd.isna(a) or pd.isna(b) else student_t_two_sided(float(a), float(b))
        for a, b in zip(t, dof)
    ], dtype="float64")
