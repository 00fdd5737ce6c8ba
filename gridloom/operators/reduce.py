"""Reductions over axes. Partial sums are made before the shuffle; no axis: over the whole grid.

NaN spreads through min, max, sum, mean, variance and stdev, and is skipped by their nan forms. Weights: True takes the
product of the reduced axes' own, False none, an SQL expression or Column is taken as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.npmath import NAN, back, nn, num
from ..grid import Grid
from .index import indexed


def weight(g: Grid, axes, weights=True) -> Column | None:
    if weights is False or weights is None:
        return None
    if isinstance(weights, (str, Column)):
        return F.expr(weights) if isinstance(weights, str) else weights
    own = [F.expr(a.weights) for a in axes if a.weights]
    return fold(lambda a, b: a * b, own) if own else None


def any_nan(v: Column) -> Column:
    return F.coalesce(F.max(F.isnan(v)), F.lit(False))


def _min(v, w):
    return F.when(any_nan(v), NAN).otherwise(F.min(v))


def _nanvar(v, w):
    return back(F.var_samp(nn(v))) if w is None else _wvar(nn(v), F.when(~F.isnan(v), w))


def _wvar(v, w):
    total = F.sum(w)
    return back(F.when(total > 1, (F.sum(w * v * v) - F.pow(F.sum(w * v), F.lit(2.0)) / total) / (total - 1)))


def _var(v, w):
    return F.when(any_nan(v), NAN).otherwise(_nanvar(v, w))


#: By name: from a value and a weight (or None) to an aggregate.
AGGREGATES: Mapping[str, Callable[[Column, Column | None], Column]] = {
    "min": _min,
    "max": lambda v, w: F.max(v),
    "nanmin": lambda v, w: back(F.min(nn(v))),
    "nanmax": lambda v, w: back(F.max(nn(v))),
    "sum": lambda v, w: F.sum(v if w is None else v * w),
    "nansum": lambda v, w: F.coalesce(F.sum(nn(v) if w is None else nn(v) * w), F.lit(0.0)),
    "mean": lambda v, w: F.avg(v) if w is None else F.sum(v * w) / F.sum(w),
    "nanmean": lambda v, w: back(F.avg(nn(v))) if w is None else back(F.sum(nn(v) * w) / F.nullif(F.sum(F.when(~F.isnan(v), w)), F.lit(0.0))),
    "variance": _var,
    "nanvariance": _nanvar,
    "stdev": lambda v, w: F.sqrt(F.greatest(_var(v, w), F.lit(0.0))),
    "nanstdev": lambda v, w: F.sqrt(F.greatest(_nanvar(v, w), F.lit(0.0))),
    "count": lambda v, w: F.count(nn(v)).cast("double"),
}


def reduced(g: Grid, how: str | Callable, axes, weights=False) -> Grid:
    f = AGGREGATES[how] if isinstance(how, str) else how
    gone = [g.axis(a) for a in axes] or list(g.axes)
    left = tuple(a for a in g.axes if a not in gone)
    w = weight(g, gone, weights)
    keys = [c for a in left for c in a.all_columns]
    aggs = [f(num(v), w).alias(v) for v in g.values]
    if keys:
        return Grid(g.df.groupBy(*keys).agg(*aggs), left, g.values, g.atts)
    if g.df.isEmpty():
        raise ValueError("a reduction over an axis of length 0")
    return Grid(g.df.agg(*aggs), left, g.values, g.atts)


def _op(name: str, weighted: bool):
    def run(g: Grid, *axes, weights=weighted) -> Grid:
        return reduced(g, name, axes, weights)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"`{name}` over the axes."
    return run


min_, max_, nanmin, nanmax = (_op(n, False) for n in ("min", "max", "nanmin", "nanmax"))
sum_, nansum = _op("sum", False), _op("nansum", True)
mean, nanmean = _op("mean", True), _op("nanmean", True)
variance, nanvariance, stdev, nanstdev = (_op(n, False) for n in ("variance", "nanvariance", "stdev", "nanstdev"))


def _arg(g: Grid, which, largest: bool) -> Grid:
    axis = g.axis(which)
    df = indexed(g, axis)
    out = []
    for v in g.values:
        c = num(v)
        first_nan = F.isnan(c).cast("int")
        rank = F.struct(first_nan, F.when(F.isnan(c), 0.0).otherwise(c if largest else -c), -F.col("__i"))
        out.append(F.max_by(F.col("__i"), rank).cast("long").alias(v))
    left = tuple(a for a in g.axes if a != axis)
    keys = [c for a in left for c in a.all_columns]
    return Grid(df.groupBy(*keys).agg(*out) if keys else df.agg(*out), left, g.values, g.atts)


def argmax(g: Grid, which) -> Grid:
    """Position of the largest value, the first of equal ones; a NaN counts as the largest."""
    return _arg(g, which, True)


def argmin(g: Grid, which) -> Grid:
    """Position of the smallest value, the first of equal ones; a NaN counts as the smallest."""
    return _arg(g, which, False)


def distinct_fields(g: Grid, which, names: list[str]):
    """The distinct tuples of some fields of a time axis, in order."""
    from ..functions.calendar import fields

    axis = g.axis(which)
    f = fields(F.col(axis.coordinate), axis.calendar or "standard")
    return g.df.select(*[f[n].alias(n) for n in names]).distinct().orderBy(*names)


def binned(g: Grid, which, bins: Column, name: str = "bin", how: str = "sum") -> Grid:
    """Values of a line summed (or reduced otherwise) by a bin of the coordinate, with their number."""
    axis = g.axis(which)
    from ..axes import Axis

    df = g.df.withColumn(name, bins).groupBy(*g.outer(axis), name)
    out = df.agg(*[AGGREGATES[how](num(v), None).alias(v) for v in g.values], F.count(F.lit(1)).alias("n"))
    return Grid(out, (*[a for a in g.axes if a != axis], Axis(name, "index")), (*g.values, "n"), g.atts)
