"""Selection by keyword, on coordinates and auxiliary columns.

`ax=x`: nearest coordinate of a floating-point axis, equal one otherwise; `ax=(a, b)`: closed range in either order.
Prefixes, which combine: `l_` a list, `n_` the complement, `i_` positions (k, (i, j), (i, j, step) or a list),
`s_` squeezes the axis away, `m_` takes its weighted mean. Time axes take dates as text, and their fields (`month=1`,
`l_month=[12, 1, 2]`) as keywords. Predicates reach the scan wherever they need no position.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..axes import Axis
from ..functions import calendar
from ..grid import Grid
from .index import indexed, positions

_KEY = re.compile(r"^(?:(?P<prefix>[lnisme]+)_)?(?P<name>.+)$")


def _target(g: Grid, key: str) -> tuple[str, Axis, str]:
    """Prefix letters, axis, and the column or field that a keyword is about."""
    tries = [("", key)]
    m = _KEY.match(key)
    if m and m["prefix"]:
        tries.append((m["prefix"], m["name"]))
    for prefix, name in tries:
        for a in g.axes:
            if name in a.all_columns and name != a.name:
                return prefix, a, name
        for a in g.axes:
            if a.is_a("time") and name in calendar.FIELDS:
                return prefix, a, name
        if g.has_axis(name):
            a = g.axis(name)
            return prefix, a, a.columns[0]
    raise KeyError(f"no axis or auxiliary column for {key!r}")


def applicable(g: Grid, selection: Mapping) -> dict:
    out = {}
    for k, v in selection.items():
        try:
            _target(g, k)
        except KeyError:
            continue
        out[k] = v
    return out


def _literal(axis: Axis, value, kind: T.DataType) -> Column:
    if isinstance(value, Column):
        return value
    if axis.is_a("time") and isinstance(value, str):
        if axis.calendar not in ("365", "360", "yearless"):
            return F.lit(calendar.timestamp_text(value)).cast(kind)
        return calendar.seconds_of_fields({k: F.lit(v) for k, v in calendar.parse(value).items()}, axis.calendar)
    return F.lit(value)


def nearest(g: Grid, axis: Axis, values: list) -> list:
    """Of each value the nearest coordinate, the smaller of two, from one aggregate over the axis."""
    c = F.col(axis.coordinate)
    kind = g.df.schema[axis.coordinate].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        gap = lambda x: F.abs(F.unix_micros(c.cast("timestamp")) - F.unix_micros(x.cast(kind).cast("timestamp")))
    else:
        gap = lambda x: F.abs(c - x)
    return list(g.df.agg(*[F.min_by(c, F.struct(gap(_literal(axis, v, kind)), c)).alias(f"_{i}") for i, v in enumerate(values)]).first())


def _floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType, T.TimestampNTZType, T.TimestampType, T.DateType))


def _by_position(value, column: str, n: Column) -> Column:
    i = F.col(column)
    at = lambda k: F.lit(k) if k >= 0 else n + k
    if isinstance(value, slice):
        value = (value.start, value.stop, value.step or 1)
    if isinstance(value, tuple):
        lo, hi, step = (*value, 1)[:3] if len(value) < 3 else value
        step = step or 1
        if step < 0:
            raise ValueError("a grid has no order of cells: steps are positive; see `taken` for other orders")
        lo, hi = at(lo or 0), n if hi is None else at(hi)
        return (i >= lo) & (i < hi) & (F.pmod(i - F.greatest(lo, F.lit(0)), F.lit(step)) == 0)
    if isinstance(value, list):
        return i.isin([k for k in value if k >= 0]) | F.coalesce(F.array_contains(F.array(*[at(k) for k in value if k < 0]) if any(k < 0 for k in value) else F.array().cast("array<int>"), i), F.lit(False))
    return i == at(value)


def select(g: Grid, **selection) -> Grid:
    means, squeezed = [], []
    for key, value in selection.items():
        prefix, axis, name = _target(g, key)
        if "m" in prefix:
            means.append(axis.name)
        if "s" in prefix:
            squeezed.append(axis.name)
        if "i" in prefix:
            dims = positions(g, axis)
            test = _by_position(value, "__i", F.col("__n"))
            kept = dims.join(dims.agg(F.count(F.lit(1)).alias("__n"))).where(~test if "n" in prefix else test).select(*axis.columns)
            g = g.with_df(g.df.join(kept, list(axis.columns), "left_semi"))
            continue
        field = name not in g.df.columns
        column = calendar.fields(F.col(axis.coordinate), axis.calendar or "standard")[name] if field else F.col(name)
        kind = T.IntegerType() if field else g.df.schema[name].dataType
        snap = not field and name in axis.columns and _floating(kind) and not axis.is_a("noncoordinate")
        if "l" in prefix or isinstance(value, list):
            values = nearest(g, axis, list(value)) if snap and len(value) else [_literal(axis, v, kind) for v in value]
            test = column.isin(values) if len(values) else F.lit(False)
        elif isinstance(value, tuple):
            a, b = (_literal(axis, v, kind) for v in value)
            test = column.between(F.least(a, b), F.greatest(a, b))
        elif snap:
            test = column == F.lit(nearest(g, axis, [value])[0])
        else:
            test = column == _literal(axis, value, kind)
        g = g.with_df(g.df.where(~test if "n" in prefix else test))
    if means:
        from .reduce import mean

        g = mean(g, *dict.fromkeys(means))
    return squeeze(g, *dict.fromkeys(squeezed)) if squeezed else g


def squeeze(g: Grid, *which) -> Grid:
    """Without the named axes, or without any whose length is 1; a longer one is an error."""
    names = [g.axis(w).name for w in which]
    if not names:
        sizes = g.df.agg(*[F.count_distinct(*a.columns).alias(a.name) for a in g.axes]).first() if g.axes else {}
        names = [a.name for a in g.axes if sizes[a.name] == 1]
        return Grid(g.df.select(*[c for a in g.axes if a.name not in names for c in a.all_columns], *g.values), tuple(a for a in g.axes if a.name not in names), g.values, g.atts)
    left = tuple(a for a in g.axes if a.name not in names)
    sizes = g.df.agg(*[F.count_distinct(*g.axis(n).columns).alias(n) for n in names]).first()
    if long := [n for n in names if sizes[n] > 1]:
        raise ValueError(f"axes longer than 1: {long}")
    return Grid(g.df.select(*[c for a in left for c in a.all_columns], *g.values), left, g.values, g.atts)


def taken(g: Grid, which, order: list[int], name: str = "pos") -> Grid:
    """The coordinates at these positions, in this order and with repeats; an axis `name` gives the new places."""
    axis = g.axis(which)
    dims = positions(g, axis)
    size = dims.agg(F.count(F.lit(1)).alias("__n"))
    wanted = g.spark.createDataFrame([(p, int(k)) for p, k in enumerate(order)], f"`{name}` int, __k int")
    at = wanted.join(size).withColumn("__i", F.when(F.col("__k") < 0, F.col("__k") + F.col("__n")).otherwise(F.col("__k")).cast("int"))
    out = g.df.join(dims.join(at, "__i").select(*axis.columns, name), list(axis.columns))
    kept = [a if a.name != axis.name else Axis(name, "index", aux=axis.all_columns) for a in g.axes]
    return Grid(out, tuple(kept), g.values, g.atts).tidy()


def sliced(g: Grid, items) -> Grid:
    """`g[...]`: whole numbers (their axes go), slices, lists and one Ellipsis, an item an axis in order. As a grid's cells have
    no order but their coordinates', a slice with a negative step picks the same cells as its reverse."""
    items = list(items) if isinstance(items, tuple) else [items]
    if sum(x is Ellipsis for x in items) > 1 or len([x for x in items if x is not Ellipsis]) > len(g.axes):
        raise IndexError("more items than axes")
    if Ellipsis in [x for x in items if isinstance(x, type(Ellipsis))]:
        at = next(i for i, x in enumerate(items) if x is Ellipsis)
        items[at : at + 1] = [slice(None)] * (len(g.axes) - len(items) + 1)
    picks = {}
    for axis, item in zip(g.axes, items, strict=False):
        if isinstance(item, slice):
            if item == slice(None):
                continue
            if item.start is not None and item.start < 0 or item.stop is not None and item.stop < 0 or (item.step or 1) < 0:
                item = list(range(*item.indices(g.dimension(axis).count())))
            picks[f"i_{axis.name}"] = item
        elif isinstance(item, (list, tuple)):
            picks[f"i_{axis.name}"] = [int(k) for k in item]
        else:
            picks[f"si_{axis.name}"] = int(item)
    return select(g, **picks)


def compare(g: Grid, op: str, other: float) -> Grid:
    """A boolean for each cell; no cell goes."""
    from ..functions.npmath import BINARY

    return g.mapped(lambda c: BINARY[op](c, other))


def sort(g: Grid, **directions: int) -> DataFrame:
    """The cells in order: 1 ascending, -1 descending, 0 the axis's natural direction; other axes follow ascending."""
    cols = []
    for k, d in directions.items():
        a = g.axis(k)
        cols += [F.col(c).desc() if (d or a.order) < 0 else F.col(c).asc() for c in a.columns]
    named = {g.axis(k).name for k in directions}
    return g.df.orderBy(*cols, *[c for a in g.axes if a.name not in named for c in a.columns])


def monotonic(df: DataFrame, column: str, position: str) -> int:
    """1 if the values rise with the position, -1 if they fall, 0 otherwise."""
    from pyspark.sql import Window

    step = F.signum(F.col(column) - F.lag(column).over(Window.orderBy(position)))
    lo, hi = df.select(step.alias("s")).agg(F.min("s"), F.max("s")).first()
    return int(lo) if lo is not None and lo == hi else 0


def head(g: Grid, which, n: int, step: int = 1) -> Grid:
    return select(g, **{f"i_{g.axis(which).name}": (0, n, step)})


__all__ = ["select", "squeeze", "taken", "compare", "sort", "monotonic", "head", "nearest", "applicable", "indexed"]
