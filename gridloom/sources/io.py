"""Reading and writing grids: Parquet (with the description beside it in the schema's metadata), CSV, pandas, Arrow.

Formats and axis kinds can be added: `register_reader`, `register_writer`. Paths go to Spark's readers only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import Axis
from ..grid import Dataset, Grid, grid
from . import cf

READERS: dict[str, Callable] = {}
WRITERS: dict[str, Callable] = {}


def register_reader(name: str, f: Callable) -> None:
    READERS[name] = f


def register_writer(name: str, f: Callable) -> None:
    WRITERS[name] = f


def read_table(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


def open_grid(spark: SparkSession, path, fmt: str = "parquet", axes: Sequence[Axis] | None = None, values: Sequence[str] | None = None, atts: Mapping | None = None, names: Mapping[str, str] | None = None, kinds: Mapping[str, str] | None = None, override: Mapping[str, DataFrame] | None = None, **options) -> Grid:
    """A grid from a table. Axes are given, or are those written with it. names: renamed columns; kinds: other kinds of
    axes; override: tables (old coordinate, `value`) that replace an axis's coordinates."""
    if fmt in READERS:
        return READERS[fmt](spark, path, **options)
    df = read_table(spark, path, fmt, **options)
    if axes is None:
        axes, values, atts = described(df)
    g = grid(df, axes, list(values or [c for c in df.columns if c not in {x for a in axes for x in a.all_columns}]), atts)
    for axis, table in (override or {}).items():
        a = g.axis(axis)
        g = g.with_df(g.df.join(table, a.coordinate).withColumn(a.coordinate, F.col("value")).drop("value")).tidy()
    if names:
        from ..operators.shape import rename_axes

        g = rename_axes(g, **{k: v for k, v in names.items() if g.has_axis(k)})
        g = g.with_df(g.df.withColumnsRenamed({k: v for k, v in names.items() if k in g.values}), values=tuple(names.get(v, v) for v in g.values))
    return cast_axes(g, kinds) if kinds else g


def cast_axes(g: Grid, kinds: Mapping[str, str | Axis]) -> Grid:
    from dataclasses import replace

    new = {g.axis(k).name: v for k, v in kinds.items()}
    return replace(g, axes=tuple((new[a.name] if isinstance(new[a.name], Axis) else replace(a, kind=new[a.name])) if a.name in new else a for a in g.axes))


def described(df: DataFrame) -> tuple[list[Axis], list[str], dict]:
    """Axes, values and attributes from the columns' metadata that `save` writes."""
    for f in df.schema:
        if "grid" in f.metadata:
            about = json.loads(f.metadata["grid"])
            axes = [Axis(**{**a, "columns": tuple(a["columns"]), "aux": tuple(a["aux"])}) for a in about["axes"]]
            return axes, about["values"], about["atts"]
    raise ValueError("the table doesn't say what its axes are: give them")


def description(g: Grid) -> str:
    plain = lambda m: {k: v for k, v in m.items() if isinstance(v, (str, int, float, bool))}
    axes = [{"name": a.name, "kind": a.kind, "columns": list(a.columns), "units": a.units, "weights": a.weights, "aux": list(a.aux), "rtol": a.rtol, "order": a.order, "atts": plain(a.atts)} for a in g.axes]
    return json.dumps({"axes": axes, "values": list(g.values), "atts": plain(g.atts)})


def save(g: Grid, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", pack: bool = False, **options) -> None:
    """Writes the cells; Parquet keeps the description, which `open_grid` reads back. pack: 16-bit values."""
    if fmt in WRITERS:
        return WRITERS[fmt](g, path, **options)
    if pack:
        g, how = cf.packed(g)
        g = Grid(g.df, g.axes, g.values, {**g.atts, **how})
    first = g.df.columns[-1]
    df = g.df.withColumn(first, F.col(first).alias(first, metadata={"grid": description(g)}))
    writer = df.write.mode(mode).format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def unpack(g: Grid) -> Grid:
    """Values of a grid written with `pack`."""
    atts = {k: v for k, v in g.atts.items() if k not in ("scale_factor", "add_offset", "_FillValue")}
    return Grid(g.df.withColumn(g.value, cf.unpacked(F.col(g.value), g.atts)), g.axes, g.values, atts)


def from_pandas(spark: SparkSession, frame, axes: Sequence[Axis], values: Sequence[str] | str, atts: Mapping | None = None) -> Grid:
    return grid(spark.createDataFrame(frame), axes, values, atts)


def from_arrays(spark: SparkSession, array, axes: Sequence[Axis], coordinates: Sequence[Sequence], name: str = "v") -> Grid:
    """A dense array with its coordinates, as cells."""
    import numpy as np
    import pandas as pd

    array = np.asarray(array)
    mesh = np.meshgrid(*[np.arange(n) for n in array.shape], indexing="ij") if array.ndim else []
    frame = {a.coordinate: np.asarray(c)[m.ravel()] for a, c, m in zip(axes, coordinates, mesh, strict=True)}
    return from_pandas(spark, pd.DataFrame(frame | {name: array.ravel()}), axes, name)


def to_array(g: Grid):
    """The values as a dense array in the axes' order, NaN where there is no cell."""
    import numpy as np

    cells = g.get()
    dims = [np.unique(cells[a.coordinate].to_numpy()) for a in g.axes]
    out = np.full([len(d) for d in dims], np.nan)
    out[tuple(np.searchsorted(d, cells[a.coordinate].to_numpy()) for d, a in zip(dims, g.axes, strict=True))] = cells[g.value].to_numpy(float)
    return out


def to_arrow(g: Grid):
    return g.tidy().df.toArrow()


def wide(d: Dataset) -> DataFrame:
    """Grids of the same axes as one table with a column each."""
    first, *rest = list(d)
    df = first.df
    for g in rest:
        df = df.join(g.df, g.keys, "full")
    return df
