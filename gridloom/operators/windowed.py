"""Ordered-axis operators: derivatives, differences, integrals, smoothing, lags, composites.

Each is a window over the lines along one axis (partitioned by all other coordinates) and runs in generated code. With
`within=(lo, hi)` only the coordinates in the range are returned, and the cells that they need beside it are taken
first: Catalyst doesn't push a range of the ordering column below a window, so the widened range is filtered before it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.npmath import NAN, num
from ..grid import Grid
from .index import indexed, line, positions


def halo(g: Grid, which, within: tuple, before: int, after: int) -> Grid:
    """Cells in the closed range and so many coordinates beside it."""
    axis = g.axis(which)
    dims = positions(g, axis)
    inside = dims.where(F.col(axis.coordinate).between(*[F.lit(x) for x in within]))
    lo, hi = inside.agg(F.min("__i"), F.max("__i")).first()
    if lo is None:
        return g.with_df(g.df.where(F.lit(False)))
    edge = dims.where(F.col("__i").between(lo - before, hi + after)).agg(F.min(axis.coordinate), F.max(axis.coordinate)).first()
    return g.with_df(g.df.where(F.col(axis.coordinate).between(F.lit(edge[0]), F.lit(edge[1]))))


def _cut(g: Grid, axis: Axis, within: tuple | None) -> Grid:
    return g if within is None else g.with_df(g.df.where(F.col(axis.coordinate).between(*[F.lit(x) for x in within])))


def _x(g: Grid, axis: Axis, dx: str | Column | None) -> Column:
    if dx is not None:
        return F.expr(dx) if isinstance(dx, str) else dx
    kind = g.df.schema[axis.coordinate].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(axis.coordinate).cast("timestamp")) / 86400e6
    return F.datediff(F.col(axis.coordinate), F.lit("1970-01-01")).cast("double") if kind == "date" else num(axis.coordinate)


def deriv(g: Grid, which, df: str = "centre", dx=None, within: tuple | None = None) -> Grid:
    """First derivative (`centre`, `left`, `right`) or second (`2`), over uneven steps; one-sided at the ends."""
    axis = g.axis(which)
    reach = 2 if df == "2" else 1
    src = halo(g, axis, within, reach, reach) if within else g
    w = line(g, axis)
    x = _x(g, axis, dx)
    rows = src.df.withColumns({"__x": x, "__xl": F.lag(x).over(w), "__xr": F.lead(x).over(w)})
    out = {}
    for v in g.values:
        c = num(v)
        left, right = F.lag(c).over(w), F.lead(c).over(w)
        first, last = F.col("__xl").isNull(), F.col("__xr").isNull()
        lo = (c - left) / (F.col("__x") - F.col("__xl"))
        hi = (right - c) / (F.col("__xr") - F.col("__x"))
        if df == "centre":
            out[v] = (F.when(last, c).otherwise(right) - F.when(first, c).otherwise(left)) / (F.when(last, F.col("__x")).otherwise(F.col("__xr")) - F.when(first, F.col("__x")).otherwise(F.col("__xl")))
        elif df == "left":
            out[v] = F.when(first, hi).otherwise(lo)
        elif df == "right":
            out[v] = F.when(last, lo).otherwise(hi)
        elif df == "2":
            pick = lambda c, k: F.when(first, F.lead(c, k + 1).over(w) if k + 1 else c).when(last, F.lag(c, 1 - k).over(w) if k < 1 else c).otherwise((F.lag(c).over(w), c, F.lead(c).over(w))[k + 1])
            (xa, va), (xc, vc), (xb, vb) = ((pick(F.col("__x"), k), pick(c, k)) for k in (-1, 0, 1))
            out[v] = 2 * ((xb - xc) * va + (xa - xb) * vc + (xc - xa) * vb) / ((xb - xc) * (xc - xa) * (xb - xa))
        else:
            raise ValueError(f"no such difference: {df}")
    return _cut(g.with_df(rows.withColumns(out)).tidy(), axis, within)


def diff(g: Grid, which, n: int = 1, within: tuple | None = None) -> Grid:
    """n-th forward difference at the first coordinates; the last n go."""
    from math import comb

    axis = g.axis(which)
    src = halo(g, axis, within, 0, n) if within else g
    w = line(g, axis)
    rows = src.df.withColumn("__in", F.lead(F.lit(1), n).over(w) if n else F.lit(1))
    out = {v: sum((((-1) ** k * comb(n, k)) * (F.lead(num(v), n - k).over(w) if n - k else num(v)) for k in range(n + 1)), F.lit(0.0)) for v in g.values}
    return _cut(g.with_df(rows.withColumns(out).where("__in = 1")).tidy(), axis, within)


BLOCK = 65536


def _before(g: Grid, axis: Axis, rows: DataFrame, cells: dict[str, Column], descending: bool) -> DataFrame:
    """Adds, under its name, what each of `cells` is at the coordinate before; null at the first. A grid that is one line is cut into
    blocks of positions (`__block`), and what ends a block goes to the next one in a table of a row a block."""
    if g.outer(axis):
        w = line(g, axis, descending)
        return rows.withColumns({n: F.lag(c).over(w) for n, c in cells.items()})
    dims = positions(g, axis).withColumn("__block", F.floor(F.col("__i") / BLOCK))
    rows = rows.withColumns({f"__c_{n}": c for n, c in cells.items()}).join(dims.drop("__i"), list(axis.columns))
    last = (F.min_by if descending else F.max_by)(F.struct(*[f"__c_{n}" for n in cells]), F.struct(*axis.columns))
    ends = rows.groupBy("__block").agg(last.alias("__end")).withColumn("__block", F.col("__block") + (-1 if descending else 1))
    inside = Window.partitionBy("__block").orderBy(*[F.col(c).desc() if descending else F.col(c) for c in axis.columns])
    first = F.row_number().over(inside) == 1
    rows = rows.join(ends, "__block", "left")
    return rows.withColumns({n: F.when(first, F.col(f"__end.__c_{n}")).otherwise(F.lag(f"__c_{n}").over(inside)) for n in cells})


def _running(g: Grid, axis: Axis, rows: DataFrame, terms: dict[str, Column], descending: bool) -> DataFrame:
    """Sums of the terms up to each coordinate. A grid that is one line is summed block by block, the blocks' totals
    before them: no task holds the line."""
    w = line(g, axis, descending).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__t_{v}": t for v, t in terms.items()})
    if g.outer(axis):
        return rows.withColumns({v: F.sum(f"__t_{v}").over(w) for v in terms})
    totals = rows.groupBy("__block").agg(*[F.sum(f"__t_{v}").alias(f"__b_{v}") for v in terms])
    upto = Window.orderBy(F.col("__block").desc() if descending else "__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", *[F.coalesce(F.sum(f"__b_{v}").over(upto), F.lit(0.0)).alias(f"__b_{v}") for v in terms])
    inside = Window.partitionBy("__block").orderBy(*[F.col(c).desc() if descending else F.col(c) for c in axis.columns]).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(totals, "__block").withColumns({v: F.sum(f"__t_{v}").over(inside) + F.col(f"__b_{v}") for v in terms})


def integrate(g: Grid, which, kind: str = "trapz", v0: float = 0.0, order: int = 1, dx=None) -> Grid:
    """Running integral, v0 at the first coordinate (the last one for order -1; steps keep their sign)."""
    axis = g.axis(which)
    x = _x(g, axis, dx)
    rows = _before(g, axis, g.df, {"__px": x} | {f"__p_{v}": num(v) for v in g.values}, order < 0)
    step = x - F.col("__px") if order > 0 else F.col("__px") - x
    term = {"trapz": lambda c, p: (c + p) / 2, "rectl": lambda c, p: p if order > 0 else c, "rectr": lambda c, p: c if order > 0 else p}[kind]
    terms = {v: F.coalesce(step * term(num(v), F.col(f"__p_{v}")), F.lit(float(v0))) for v in g.values}
    return g.with_df(_running(g, axis, rows, terms, order < 0)).tidy()


def cumsum(g: Grid, which, v0: float = 0.0, order: int = 1, mode: str = "sum") -> Grid:
    """Running sum from v0. `mode="after"`: the first coordinate's value is replaced by v0."""
    axis = g.axis(which)
    rows = _before(g, axis, g.df, {"__one": F.lit(1)}, order < 0)
    first = F.col("__one").isNull()
    terms = {v: F.when(first, F.lit(float(v0)) if mode == "after" else num(v) + v0).otherwise(num(v)) for v in g.values}
    return g.with_df(_running(g, axis, rows, terms, order < 0)).tidy()


def smooth(g: Grid, which, kernel: int | Sequence[float] = 15, within: tuple | None = None) -> Grid:
    """Convolution with a kernel of sum 1 (a number: a Hann window so long), values mirrored about the ends."""
    axis = g.axis(which)
    k = np.hanning(kernel) if isinstance(kernel, (int, np.integer)) else np.asarray(kernel, float)
    if len(k) <= 2 and isinstance(kernel, (int, np.integer)):
        return g
    k = k / k.sum()
    src = halo(g, axis, within, len(k), len(k)) if within else g
    w = line(g, axis)
    n = F.count(F.lit(1)).over(Window.partitionBy(*g.outer(axis)))
    rows = src.df.withColumns({"__p": F.row_number().over(w) - 1, "__n": n})
    out = {}
    for v in g.values:
        total = F.lit(0.0)
        for j, kj in enumerate(k):
            if kj == 0:
                continue
            s = (len(k) - 1) // 2 - j  # the place asked for is p + s
            c = num(v)
            if s == 0:
                total = total + float(kj) * c
                continue
            here = F.lead(c, s).over(w) if s > 0 else F.lag(c, -s).over(w)
            # beyond an end by m places stands what is m - 1 places inside it
            inside = _mirrored(c, s, w, g, axis)
            total = total + float(kj) * F.when((F.col("__p") + s >= 0) & (F.col("__p") + s < F.col("__n")), here).otherwise(inside)
        out[v] = total
    return _cut(g.with_df(rows.withColumns(out)).tidy(), axis, within)


def _mirrored(c: Column, s: int, w, g: Grid, axis: Axis) -> Column:
    """The value at the mirrored place, which is among the first or last |s| of the line."""
    full = line(g, axis).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = Window.partitionBy(*g.outer(axis)).orderBy(*[F.col(x).desc() for x in axis.columns]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if s < 0:
        return F.element_at(F.array(*[F.nth_value(c, m).over(full) for m in range(1, -s + 1)]), F.greatest(-(F.col("__p") + s), F.lit(1)).cast("int"))
    return F.element_at(F.array(*[F.nth_value(c, m).over(back) for m in range(1, s + 1)]), F.greatest(F.col("__p") + s - F.col("__n") + 1, F.lit(1)).cast("int"))


def lag(g: Grid, which, lags: Sequence[int], name: str = "lag") -> Grid:
    """A new axis of lags: at each the value so many coordinates on, NaN beyond the ends."""
    axis = g.axis(which)
    w = line(g, axis)
    shift = lambda c, k: c if k == 0 else F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    inside = lambda k: shift(F.lit(1), k).isNotNull()
    structs = [F.struct(F.lit(int(k)).alias(name), *[F.when(inside(k), shift(num(v), k)).otherwise(NAN).alias(v) for v in g.values]) for k in lags]
    rows = g.df.withColumn("__lags", F.array(*structs)).select(*g.keys, F.explode("__lags").alias("__l")).select(*g.keys, "__l.*")
    return Grid(rows, (*g.axes, Axis(name, "lag")), g.values, g.atts).tidy()


def composite(g: Grid, which, events: DataFrame, length: int, before: int = 0, column: str | None = None) -> Grid:
    """Windows around events: at event e and offset o the value o coordinates after it, NaN outside the axis.

    events: a table with the events' coordinates in `column`, and optionally their own `length` and `before`. Each
    event asks for its few positions, and these meet the cells in an equi-join.
    """
    axis = g.axis(which)
    col = column or axis.coordinate
    own = lambda n, d: F.col(n) if n in events.columns else F.lit(d)
    dims = positions(g, axis)
    numbered = events.select(F.col(col).alias(axis.coordinate), own("length", length).alias("__len"), own("before", before).alias("__before")).join(dims, axis.coordinate)
    numbered = numbered.withColumn("event", F.row_number().over(Window.orderBy("__i")))
    asked = numbered.select("event", "__i", F.explode(F.sequence(-F.col("__before"), F.col("__len") - F.col("__before") - 1)).alias("offset")).withColumn("__at", F.col("__i") + F.col("offset")).drop("__i")
    asked = asked.join(dims.withColumnRenamed("__i", "__at").select("__at", *axis.columns), "__at", "left")
    outer = g.outer(axis)
    every = asked.crossJoin(g.df.select(*outer).distinct()) if outer else asked
    out = every.join(g.df, [*axis.columns, *outer], "left").withColumns({v: F.coalesce(num(v), F.lit(NAN)) for v in g.values})
    rest = [a for a in g.axes if a != axis]
    return Grid(out, (Axis("event", "event"), Axis("offset", "offset"), *rest), g.values, g.atts).tidy()


__all__ = ["deriv", "diff", "integrate", "cumsum", "smooth", "lag", "composite", "halo", "indexed"]
