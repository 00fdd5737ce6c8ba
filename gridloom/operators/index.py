"""Positions along an axis, from its dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..grid import Grid


def positions(g: Grid, which, name: str = "__i") -> DataFrame:
    """The axis's distinct coordinates, numbered from 0 in their order. One task, over the axis and not the cells."""
    cols = g.axis(which).columns
    return g.df.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*cols)) - 1)


def indexed(g: Grid, which, name: str = "__i") -> DataFrame:
    """The cells with their position along the axis."""
    return g.df.join(positions(g, which, name), list(g.axis(which).columns))


def line(g: Grid, axis: Axis, descending: bool = False):
    """The window over one line along the axis."""
    cols = [F.col(c) for c in axis.columns]
    return Window.partitionBy(*g.outer(axis)).orderBy(*[c.desc() if descending else c for c in cols])
