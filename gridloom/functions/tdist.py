"""Student's t: two-sided p and quantiles. p by the incomplete beta function; exact finite sums as Columns for whole
degrees of freedom, an Arrow batch function for real ones."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function, for all elements at once."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / guard(1 + even * d), guard(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    got = np.where(y <= 0, 0.0, np.nan_to_num(front) * _beta_fraction(p, q, y))
    return np.where(swap, 1 - got, got)


def two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|); NaN where t is NaN or there is no degree of freedom."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out = np.full(t.shape, np.nan)
    with np.errstate(over="ignore"):
        x = df[ok] / (df[ok] + t[ok] ** 2)
    out[ok] = betainc(df[ok] / 2, 0.5, x)
    return out


def quantile(p, df) -> np.ndarray:
    """The value below which T lies with probability p, by bisection in t / (1 + |t|)."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    ok = np.isfinite(df) & (df > 0) & (p > 0) & (p < 1)
    want = 2 * np.where(p > 0.5, 1 - p, p)[ok]
    lo, hi = np.zeros(want.shape), np.ones(want.shape)
    for _ in range(80):
        mid = (lo + hi) / 2
        above = two_sided(mid / (1 - np.minimum(mid, 1 - 1e-16)), df[ok]) > want
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out = np.full(p.shape, np.nan)
    u = (lo + hi) / 2
    out[ok] = np.where(p[ok] > 0.5, 1, -1) * u / np.maximum(1 - u, 1e-300)
    return out


@F.pandas_udf(T.DoubleType())
def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided(t.astype(float), df.astype(float)))


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(quantile(p.astype(float), df.astype(float)))


def p_value_whole(t: Column, df: Column) -> Column:
    """The same for whole degrees of freedom, by the finite trigonometric series, in the JVM."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.pow(F.cos(theta), F.lit(2.0))
    even = F.pmod(df.cast("long"), F.lit(2)) == 0
    n = F.when(even, (df - 2) / 2).otherwise((df - 3) / 2).cast("long")
    series = F.aggregate(
        F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * c2 * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))).alias("term"), (a["sum"] + a["term"] * c2 * F.when(even, (2 * j - 1) / (2 * j)).otherwise(2 * j / (2 * j + 1))).alias("sum")),
        lambda a: a["sum"],
    )
    inside = F.when(even, F.sin(theta) * series).when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * series))
    return F.when(df >= 1, F.greatest(1 - inside, F.lit(0.0))).otherwise(float("nan"))
