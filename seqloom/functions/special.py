"""Upper tails of the t, F and normal distributions, vectorised, and as Arrow functions for columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_ERFC = np.frompyfunc(math.erfc, 1, 1)
_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function; NaN in, NaN out."""
    a, b, x = np.broadcast_arrays(*(np.asarray(z, float) for z in (a, b, x)))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    if ok.any():
        a, b, x = a[ok], b[ok], x[ok]
        flip = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        front = np.exp((_LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q)).astype(float) + p * np.log(z) + q * np.log1p(-z)) / p
        value = front * _fraction(p, q, z)
        out[ok] = np.where(flip, 1 - value, value)
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isinf(t), 0.0, beta_inc(df / 2, 0.5, df / (df + t * t)))


def f_upper(f, d1, d2) -> np.ndarray:
    """P(F >= f); one for f <= 0."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(z, float) for z in (f, d1, d2)))
    with np.errstate(invalid="ignore"):
        return np.where(f <= 0, 1.0, np.where(np.isinf(f), 0.0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))))


def normal_two_sided(z) -> np.ndarray:
    """2 * P(Z >= z), at most one."""
    z = np.asarray(z, float)
    return np.clip(_ERFC(z / math.sqrt(2)).astype(float), 0, 1)


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.clip(t_two_sided(t.to_numpy(), df.to_numpy()), 0, 1))


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(np.clip(f_upper(f.to_numpy(), d1.to_numpy(), d2.to_numpy()), 0, 1))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy()))
