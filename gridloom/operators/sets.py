"""Grids put together: along an axis, along a new one, by name; gaps and coverage of an axis."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..grid import Dataset, Grid, common_atts


def stacked(grids: Sequence[Grid], axis: Axis) -> Grid:
    """Grids of the same axes along a new one, numbered from 0."""
    first = grids[0]
    if any([a.name for a in g.axes] != [a.name for a in first.axes] or g.values != first.values for g in grids[1:]):
        raise ValueError("grids of other axes or values")
    parts = [g.df.withColumn(axis.coordinate, F.lit(i)) for i, g in enumerate(grids)]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    return Grid(df, (axis, *first.axes), first.values, common_atts(*[g.atts for g in grids])).tidy()


def ensemble(*grids: Grid) -> Grid:
    return stacked(grids, Axis("ensemble", "ensemble"))


def concat(*grids: Grid, which=None) -> Grid:
    """Along the one axis whose coordinates differ; along a new one, `concat`, where none does. Axes that meet in part
    only, other than that one, are an error; grids without cells add only their attributes."""
    atts = common_atts(*[g.atts for g in grids])
    grids = tuple(g for g in grids if not g.df.isEmpty()) or grids[:1]
    first = grids[0]
    if len(grids) == 1:
        return Grid(first.df, first.axes, first.values, atts)
    if which is None:
        differ = [a for a in first.axes if any(_differs(first, g, a) for g in grids[1:])]
        if len(differ) > 1:
            raise ValueError(f"several axes differ: {[a.name for a in differ]}")
        if not differ:
            return stacked(grids, Axis("concat", "index"))
        axis = differ[0]
    else:
        axis = first.axis(which)
        if any(_differs(first, g, a) for g in grids[1:] for a in first.axes if a != axis):
            raise ValueError(f"axes other than {axis.name} differ")
    aux = tuple(c for c in axis.aux if all(c in g.df.columns for g in grids))
    keep = [c for a in first.axes for c in (a.all_columns if a != axis else (*a.columns, *aux))]
    df = reduce(lambda a, b: a.unionByName(b), [g.df.select(*keep, *first.values) for g in grids])
    axes = tuple(a if a != axis else Axis(axis.name, axis.kind, axis.columns, axis.units, axis.weights, aux, axis.rtol, axis.order, common_atts(*[g.axis(axis.name).atts for g in grids])) for a in first.axes)
    return Grid(df, axes, first.values, atts)


def _differs(a: Grid, b: Grid, axis: Axis) -> bool:
    cols = list(axis.columns)
    one, two = a.df.select(*cols).distinct(), b.df.select(*cols).distinct()
    return not (one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty())


def concat_datasets(*sets: Dataset) -> Dataset:
    """By name; what one set alone has passes through."""
    names = list(dict.fromkeys(n for s in sets for n in s.grids))
    return Dataset({n: concat(*[s[n] for s in sets if n in s]) for n in names}, common_atts(*[s.atts for s in sets]))


def union_missing(frames: Sequence[DataFrame]) -> DataFrame:
    """Wide tables with different columns: those that one lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def axis_union(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).union(b.select(column)).distinct()


def axis_intersection(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def axis_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))


def gaps(df: DataFrame, column: str, step_days: int = 1) -> DataFrame:
    """Neighbouring dates further apart than a step: (gap_start, gap_end, missing)."""
    d = df.select(F.to_date(column).alias("d")).distinct()
    before = F.lag("d").over(Window.orderBy("d"))
    return d.withColumn("p", before).where(F.datediff("d", "p") > step_days).select(F.col("p").alias("gap_start"), F.col("d").alias("gap_end"), (F.datediff("d", "p") / step_days - 1).cast("int").alias("missing"))


def missing_dates(df: DataFrame, column: str) -> DataFrame:
    """Dates between the first and the last that the table lacks."""
    span = df.agg(F.to_date(F.min(column)).alias("a"), F.to_date(F.max(column)).alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("d"))
    return every.join(df.select(F.to_date(column).alias("d")).distinct(), "d", "left_anti")
