"""Two-sided Student-t tail, vectorised for a pandas UDF (continued fraction of the incomplete beta)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


#: Degrees of freedom beyond which the tail is that of the normal distribution, corrected by 1 / df.
LARGE = 1e7


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 100_000) -> np.ndarray:
    """Lentz evaluation of the incomplete-beta continued fraction; raises if it does not settle."""
    tiny = 1e-300

    def safe(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds + 1):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / safe(1.0 + coef * d)
            c = safe(1.0 + coef / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-14):
            return h
    raise ArithmeticError("incomplete beta: no convergence")


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.empty(x.shape)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    mid = (x > 0) & (x < 1)
    a, b, x = a[mid], b[mid], x[mid]
    flip = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    front = np.exp(
        _log_gamma(aa + bb) - _log_gamma(aa) - _log_gamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
    )
    part = front * _beta_fraction(aa, bb, xx) / aa
    out[mid] = np.where(flip, 1.0 - part, part)
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom; nan where undefined."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    ok = ~np.isnan(t) & (df > 0)
    finite = ok & np.isfinite(t)
    out[ok & np.isinf(t)] = 0.0
    many = finite & (df > LARGE)
    few = finite & ~many
    d = df[few]
    out[few] = incomplete_beta(d / 2.0, 0.5, d / (d + t[few] ** 2))
    z = np.abs(t[many]) * (1 - 1 / (4 * df[many])) / np.sqrt(1 + t[many] ** 2 / (2 * df[many]))
    out[many] = [math.erfc(v / math.sqrt(2)) for v in z]
    return out


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
