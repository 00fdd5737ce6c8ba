"""Projections, shapes and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions import calendar
from ..functions.npmath import NAN, num
from ..grid import Grid
from .index import positions


def extend(g: Grid, axis: Axis, dimension: DataFrame) -> Grid:
    """Every cell at each coordinate of a new axis."""
    return Grid(g.df.crossJoin(dimension.select(*axis.all_columns)), (axis, *g.axes), g.values, g.atts).tidy()


def transpose(g: Grid, *order) -> Grid:
    """Axes in this order; those not named follow."""
    first = [g.axis(o) for o in order]
    return replace(g, axes=(*first, *[a for a in g.axes if a not in first])).tidy()


def rename(g: Grid, name: str) -> Grid:
    return Grid(g.df.withColumnRenamed(g.value, name), g.axes, (name,), g.atts)


def rename_axes(g: Grid, **names: str) -> Grid:
    df, axes = g.df, list(g.axes)
    for old, new in names.items():
        a = g.axis(old)
        if a.columns == (a.name,):
            df = df.withColumnRenamed(a.name, new)
        axes[axes.index(a)] = replace(a, name=new, columns=(new,) if a.columns == (a.name,) else a.columns, weights=a.weights and a.weights.replace(f"`{a.name}`", f"`{new}`"))
    return Grid(df, tuple(axes), g.values, g.atts).tidy()


def replace_axis(g: Grid, which, new: Axis, dimension: DataFrame | None = None, relabel: Column | None = None) -> Grid:
    """New coordinates, by position from a table as long as the axis, or by an expression over the old ones."""
    a = g.axis(which)
    if relabel is not None:
        df = g.df.withColumn("__new", relabel).drop(*a.columns).withColumnRenamed("__new", new.coordinate)
    else:
        from pyspark.sql import Window

        old = positions(g, a)
        to = dimension.select(*new.all_columns).withColumn("__i", F.row_number().over(Window.orderBy(*new.columns)) - 1)
        if old.count() != dimension.count():
            raise ValueError("the new axis has another length")
        links = old.select("__i", *[F.col(c).alias(f"__o_{c}") for c in a.columns]).join(to, "__i").drop("__i")
        kept = g.df.select(*g.outer(a), *[F.col(c).alias(f"__o_{c}") for c in a.columns], *g.values)
        df = kept.join(links, [f"__o_{c}" for c in a.columns])
    return Grid(df, tuple(new if x == a else x for x in g.axes), g.values, g.atts).tidy()


def as_type(g: Grid, kind: str) -> Grid:
    """A cast; what has no value of that kind becomes NULL."""
    return g.mapped(lambda c: c.try_cast(kind))


def fill(g: Grid, value: float) -> Grid:
    return g.mapped(lambda c: F.nanvl(num(c), F.lit(float(value))))


def unfill(g: Grid, value: float) -> Grid:
    return g.mapped(lambda c: F.when(num(c) == value, NAN).otherwise(num(c)))


def scale(g: Grid, factor: float = 1.0, offset: float = 0.0) -> Grid:
    """Another unit: value * factor + offset."""
    return g.mapped(lambda c: num(c) * factor + offset)


def rotate_lon(g: Grid, origin: float = 0.0, which="lon", duplicate: bool = False) -> Grid:
    """Longitudes from `origin` to 360 degrees on; `duplicate` repeats the first meridian at the end."""
    a = g.axis(which)
    df = g.df.withColumn(a.coordinate, F.pmod(F.col(a.coordinate) - origin, F.lit(360.0)) + origin)
    if duplicate:
        df = df.unionByName(df.where(F.col(a.coordinate) == origin).withColumn(a.coordinate, F.lit(origin + 360.0)))
    return g.with_df(df)


def merge_coefs(grids: Sequence[Grid], name: str = "coef", value: str = "coefs") -> Grid:
    """Grids of one shape stacked along a new axis."""
    from .sets import stacked

    return stacked([rename(g, value) for g in grids], Axis(name, "coef"))


def split_coefs(g: Grid, which="coef") -> list[Grid]:
    a = g.axis(which)
    n = g.dimension(a).count()
    rest = tuple(x for x in g.axes if x != a)
    return [Grid(g.df.where(F.col(a.coordinate) == i).drop(a.coordinate), rest, g.values, g.atts) for i in range(n)]


def flatten(g: Grid, outer, inner, name: str = "flat", stride: float | None = None) -> Grid:
    """Two axes as one: the outer one's position times `stride` (the inner one's length) plus the inner one's position."""
    o, i = g.axis(outer), g.axis(inner)
    n = stride if stride is not None else g.dimension(i).count()
    df = g.df.join(positions(g, o, "__o"), list(o.columns)).join(positions(g, i, "__n"), list(i.columns)).withColumn(name, F.col("__o") * n + F.col("__n"))
    rest = [x for x in g.axes if x not in (o, i)]
    return Grid(df, (Axis(name, "index"), *rest), g.values, g.atts).tidy()


def split_time(g: Grid, which="time", fields: Sequence[str] = ("month", "day")) -> Grid:
    """A time axis as years by what is left of its fields. Dates that some year has and another doesn't are NaN there."""
    a = g.axis(which)
    f = calendar.fields(F.col(a.coordinate), a.calendar or "standard")
    names = ["year", *fields]
    rest = [x for x in g.axes if x != a]
    keys = [c for x in rest for c in x.all_columns]
    cells = g.df.select(*keys, *[f[n].alias(n) for n in names], *g.values)
    every = cells.select(*keys, "year").distinct().crossJoin(cells.select(*fields).distinct()) if keys else cells.select("year").distinct().crossJoin(cells.select(*fields).distinct())
    out = every.join(cells, [*keys, *names], "left").withColumns({v: F.coalesce(v, F.lit(NAN)) for v in g.values})
    axes = (Axis("year", "index"), Axis(f"{a.name}_of_year", "time", tuple(fields), atts=dict(a.atts)), *rest)
    return Grid(out, axes, g.values, g.atts).tidy()


def join_time(g: Grid, year="year", rest="time", name: str = "time") -> Grid:
    """The inverse: dates that don't exist go."""
    y, d = g.axis(year), g.axis(rest)
    parts = ", ".join(n if n in d.columns else str(least) for n, least in (("month", 1), ("day", 1), ("hour", 0), ("minute", 0), ("second", 0)))
    date = F.expr(f"try_make_timestamp_ntz(`{y.coordinate}`, {parts})")
    df = g.df.withColumn(name, date).where(F.col(name).isNotNull())
    others = [x for x in g.axes if x not in (y, d)]
    return Grid(df, (Axis(name, "standardtime"), *others), g.values, g.atts).tidy()


def densify(g: Grid, which, dimension: DataFrame | None = None) -> Grid:
    """A NaN at each coordinate of the axis that a line lacks."""
    a = g.axis(which)
    outer = g.outer(a)
    dims = (dimension if dimension is not None else g.df).select(*a.all_columns).distinct()
    every = g.df.select(*outer).distinct().crossJoin(dims) if outer else dims
    out = every.join(g.df, [*outer, *a.all_columns], "left").withColumns({v: F.coalesce(num(v), F.lit(NAN)) for v in g.values})
    return g.with_df(out).tidy()


def aux_values(g: Grid, which, name: str) -> Grid:
    """An auxiliary column as a grid of its own."""
    a = g.axis(which)
    return Grid(g.df.select(*a.columns, F.col(name).alias(f"{name}_value")).distinct(), (replace(a, aux=()),), (f"{name}_value",), {})


def weights(g: Grid, *which) -> Grid:
    """The product of the axes' weights, 1 where there are none."""
    from .reduce import weight

    axes = [g.axis(w) for w in which] or [a for a in g.axes if a.weights]
    w = weight(g, axes)
    cols = [c for a in axes for c in a.all_columns]
    return Grid(g.df.select(*cols).distinct().withColumn("weights", F.lit(1.0) if w is None else w), tuple(axes), ("weights",), {})


def format_values(g: Grid, fmt: str = "%g") -> Grid:
    return g.mapped(lambda c: F.format_string(fmt, c))


def with_metadata(g: Grid) -> DataFrame:
    """The cells, each column with what is known of it in its metadata."""
    about: Mapping[str, dict] = {c: {"axis": a.name, "kind": a.kind, "units": a.units} for a in g.axes for c in a.all_columns} | {v: {"variable": v, **{k: str(x) for k, x in g.atts.items()}} for v in g.values}
    return g.df.select(*[F.col(c).alias(c, metadata=about[c]) for c in [*g.keys, *g.values]])
