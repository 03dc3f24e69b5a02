"""Statistics over columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: The value that chi-square with one degree of freedom exceeds with probability 0.01.
CHI2_01 = 6.6348966010212145


def _term(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0))


def g_statistic(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """The likelihood-ratio statistic of a 2 x 2 table; 0 for impossible counts and for pairs met less often than by chance."""
    ab, a, b, t = (c.cast("double") for c in (n_ab, n_a, n_b, n))
    e = a * b / t
    g = _term(ab, e) + _term(a - ab, a * (t - b) / t) + _term(b - ab, (t - a) * b / t) + _term(t - a - b + ab, (t - a) * (t - b) / t)
    bad = (t <= 0) | (a <= 0) | (b <= 0) | (ab <= 0) | (a < ab) | (b < ab) | (t - a - b + ab < 0) | (ab < e)
    return F.when(bad, F.lit(0.0)).otherwise(2 * g)


def chi2_quantile(p: float) -> float:
    """The value that chi-square with one degree of freedom exceeds with probability p, from below."""
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(math.sqrt(mid / 2.0)) > p else (lo, mid)
    return lo


@F.pandas_udf(DoubleType())
def chi2_p(g: pd.Series) -> pd.Series:
    """P of a statistic with one degree of freedom (there is no erfc in SQL)."""
    return pd.Series(np.fromiter(map(math.erfc, np.sqrt(g.clip(lower=0.0).to_numpy() / 2.0)), np.float64, len(g)))


def p_value(g: Column) -> Column:
    return F.when(g <= 0, F.lit(1.0)).otherwise(chi2_p(g))


def lift(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    return n_ab.cast("double") * n / (n_a.cast("double") * n_b)


def decayed(ts: Column, as_of: float, half_life_days: float = 90.0) -> Column:
    """0.5 to the power of the age in half-lives; 0 without a time."""
    return F.when(ts.isNull() | (ts == 0), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), (F.lit(float(as_of)) - ts) / F.lit(half_life_days * 86400.0)))
