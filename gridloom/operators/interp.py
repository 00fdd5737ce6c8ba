"""Interpolation along an axis.

Linear: source cells and target coordinates in one line, each target between the last source before and the first
after it; windows only. Polynomial, natural and periodic cubic and Akima splines: an Arrow batch of whole lines.
NaN points are left out; targets outside are NaN unless a slope is given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.npmath import NAN, num
from ..grid import Grid

#: Fewest points of each kind.
LEAST = {"linear": 2, "polynomial": 3, "cspline": 3, "cspline_periodic": 2, "akima": 5, "akima_periodic": 5}


def check_monotonic(g: Grid, axis: Axis, x: str) -> None:
    w = Window.partitionBy(*g.outer(axis)).orderBy(axis.coordinate)
    sign = F.signum(F.col(x) - F.lag(x).over(w))
    if not g.df.select(*g.outer(axis), sign.alias("s")).where("s is not null and not isnan(s)").groupBy(*g.outer(axis)).agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b or a = 0").isEmpty():
        raise ValueError(f"{x} isn't monotonic along {axis.name}")


def interpolate(g: Grid, which, targets: DataFrame, out: Axis, kind: str = "linear", x: str | None = None, below: float = float("nan"), above: float = float("nan"), check: bool = True, cells: DataFrame | None = None) -> Grid:
    """Values at the coordinates in `targets` (a column named as the axis `out`), for every line.

    x: a column of the source, which may vary from line to line, to use for its coordinate. below, above: slopes
    outside. cells: targets of each line instead (with the other coordinates), as where they vary.
    """
    axis = g.axis(which)
    src = x or axis.coordinate
    if x and check:
        check_monotonic(g, axis, x)
    outer = g.outer(axis)
    source = g.df.select(*outer, num(src).alias("__x"), num(g.value).alias("__y")).where(~F.isnan("__x") & ~F.isnan("__y"))
    new = out.coordinate
    asked = cells.select(*outer, num(new).alias("__x")) if cells is not None else (g.df.select(*outer).distinct().crossJoin(targets.select(num(new).alias("__x")).distinct()) if outer else targets.select(num(new).alias("__x")).distinct())
    rest = tuple(a for a in g.axes if a != axis)
    if kind == "linear":
        done = _linear(source, asked, outer, below, above)
    else:
        done = _splines(source, asked, outer, kind, below, above)
    value = g.value
    return Grid(done.select(*outer, F.col("__x").alias(new), F.col("__v").alias(value)), (*rest, out), (value,), g.atts)


def _linear(source: DataFrame, asked: DataFrame, outer: list[str], below: float, above: float) -> DataFrame:
    both = source.withColumn("__t", F.lit(0)).unionByName(asked.select(*outer, "__x", F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__t")))
    point = F.when(F.col("__t") == 0, F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    w = Window.partitionBy(*outer).orderBy("__x", "__t")
    to_here, onward, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(*outer)
    near = both.withColumns({"__l": F.last(point, ignorenulls=True).over(to_here), "__r": F.first(point, ignorenulls=True).over(onward), "__n": F.count(point).over(whole)}).where("__t = 1")
    slope = (F.col("__r.y") - F.col("__l.y")) / (F.col("__r.x") - F.col("__l.x"))
    inside = F.when(F.col("__l.x") == F.col("__x"), F.col("__l.y")).otherwise(F.col("__l.y") + slope * (F.col("__x") - F.col("__l.x")))
    lo = F.col("__r.y") + F.lit(below) * (F.col("__x") - F.col("__r.x"))
    hi = F.col("__l.y") + F.lit(above) * (F.col("__x") - F.col("__l.x"))
    v = F.when(F.col("__n") < LEAST["linear"], NAN).when(F.col("__l").isNotNull() & (F.col("__r").isNotNull() | (F.col("__l.x") == F.col("__x"))), inside).when(F.col("__l").isNotNull(), hi).when(F.col("__r").isNotNull(), lo).otherwise(NAN)
    return near.select(*outer, "__x", v.alias("__v"))


def natural_spline(x: np.ndarray, y: np.ndarray, periodic: bool = False) -> np.ndarray:
    """Second derivatives at the nodes."""
    n = len(x)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if periodic:
        m = n - 1
        if m < 2:
            return np.zeros(n)
        a = np.zeros((m, m))
        b = np.zeros(m)
        for i in range(m):
            p = (i - 1) % m
            a[i, i] += 2 * (h[p] + h[i])
            a[i, p] += h[p]
            a[i, (i + 1) % m] += h[i]
            b[i] = 6 * (d[i] - d[p])
        s = np.linalg.solve(a, b)
        return np.append(s, s[0])
    out = np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        out[1:-1] = np.linalg.solve(a, 6 * np.diff(d))
    return out


def akima_slopes(x: np.ndarray, y: np.ndarray, periodic: bool = False) -> np.ndarray:
    m = np.diff(y) / np.diff(x)
    if periodic:
        e = np.concatenate([m[-2:], m, m[:2]])
    else:
        e = np.concatenate([[3 * m[0] - 2 * m[1], 2 * m[0] - m[1]], m, [2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]])
    a, b = np.abs(e[3:] - e[2:-1]), np.abs(e[1:-2] - e[:-3])
    flat = a + b < 1e-300
    return np.where(flat, (e[1:-2] + e[2:-1]) / 2, (a * e[1:-2] + b * e[2:-1]) / np.where(flat, 1, a + b))


def evaluate(kind: str, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inside the nodes, which rise."""
    if kind == "polynomial":
        c = y.astype(float).copy()
        for k in range(1, len(x)):  # divided differences
            c[k:] = (c[k:] - c[k - 1 : -1]) / (x[k:] - x[:-k])
        out = np.full(at.shape, c[-1])
        for k in range(len(x) - 2, -1, -1):
            out = out * (at - x[k]) + c[k]
        return out
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, t = x[i + 1] - x[i], at - x[i]
    if kind.startswith("cspline"):
        s = natural_spline(x, y, kind.endswith("periodic"))
        return y[i] + t * ((y[i + 1] - y[i]) / h - h * (2 * s[i] + s[i + 1]) / 6) + t**2 * s[i] / 2 + t**3 * (s[i + 1] - s[i]) / (6 * h)
    if kind.startswith("akima"):
        p = akima_slopes(x, y, kind.endswith("periodic"))
        m = (y[i + 1] - y[i]) / h
        return y[i] + t * p[i] + t**2 * (3 * m - 2 * p[i] - p[i + 1]) / h + t**3 * (p[i] + p[i + 1] - 2 * m) / h**2
    raise ValueError(f"no such interpolation: {kind}")


def _splines(source: DataFrame, asked: DataFrame, outer: list[str], kind: str, below: float, above: float) -> DataFrame:
    both = source.withColumn("__t", F.lit(0)).unionByName(asked.select(*outer, "__x", F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__t")))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        nodes = cells[cells["__t"] == 0].sort_values("__x")
        want = cells[cells["__t"] == 1]
        x, y, at = nodes["__x"].to_numpy(float), nodes["__y"].to_numpy(float), want["__x"].to_numpy(float)
        v = np.full(at.shape, np.nan)
        if len(x) >= LEAST[kind]:
            inside = (at >= x[0]) & (at <= x[-1])
            v[inside] = evaluate(kind, x, y, at[inside])
            v[at < x[0]] = y[0] + below * (at[at < x[0]] - x[0])
            v[at > x[-1]] = y[-1] + above * (at[at > x[-1]] - x[-1])
        return want[outer].assign(__x=at, __v=v)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in outer) + (", " if outer else "") + "__x double, __v double"
    lines = both.groupBy(*outer) if outer else both.groupBy()
    return lines.applyInPandas(run, schema)
