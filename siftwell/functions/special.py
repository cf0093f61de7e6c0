"""Two-sided tail probabilities of the t and F statistics.

Only the statistic tables (one row per test) pass through here, never the data.
Every F tail with a whole numerator degree of freedom reduces to the t tail or an
elementary power plus a few closed terms, so one continued fraction serves both.
"""

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The few functions below travel with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LARGE_DF = 1e5


def _log_beta_half(a: float, b: float) -> float:
    """log B(a, b); the difference of two huge log-gammas is expanded where it would cancel."""
    if a < 1e4:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    ratio = b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
    return math.lgamma(b) - ratio


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for term in (even, odd):
            d = 1.0 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            value *= c * d
        if abs(value - before) <= 1e-15 * abs(value):
            break
    return value


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta_half(max(a, b), min(a, b)))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or math.isnan(df):
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > _LARGE_DF:
        # normal deviate of the t statistic; the error falls with 1 / df^2
        z = math.sqrt(df * math.log1p(t * t / df)) * (1 - 1 / (4 * df))
        return math.erfc(z / math.sqrt(2))
    return regularized_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    if math.isnan(f) or math.isnan(d1) or math.isnan(d2):
        return math.nan
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    if d1 != int(d1):
        return regularized_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
    a = d2 / 2
    log_x, odds = -math.log1p(d1 * f / d2), d1 * f / d2
    log_y = math.log(odds) + log_x
    if int(d1) % 2:
        total, b = t_two_sided(math.sqrt(d1 * f), d2), 0.5
    else:
        total, b = math.exp(a * log_x), 1.0
    # I_x(a, b + 1) = I_x(a, b) + x^a (1 - x)^b / (b B(a, b))
    while b < d1 / 2:
        total += math.exp(a * log_x + b * log_y - math.log(b) - _log_beta_half(a, b))
        b += 1
    return min(total, 1.0)


@F.pandas_udf(T.DoubleType())
def _p_value(kind: pd.Series, stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    rows = zip(kind, stat.astype(float), d1.astype(float), d2.astype(float))
    return pd.Series(
        [None if math.isnan(s) else t_two_sided(s, a) if k == "t" else f_upper(s, a, b) for k, s, a, b in rows],
        dtype="float64",
    )


def p_value(kind: Column, stat: Column, d1: Column, d2: Column) -> Column:
    """p of a 't' statistic with d1 degrees of freedom or an 'f' statistic with (d1, d2)."""
    return F.nanvl(_p_value(kind, stat, d1.cast("double"), d2.cast("double")), F.lit(None).cast("double"))
