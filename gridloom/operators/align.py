"""Alignment: which axes of two grids are one, and the join that this asks for.

Axes match by kind (one an ancestor of the other; generic ones by name too). Matched axes must hold the same
coordinates or one all of the other's: an overlap in part is an error. Floating-point coordinates are equal within the
axis's tolerance: the smaller dimension table is snapped onto the other's coordinates, and the cells then meet in an
equi-join. Time axes meet on the fields that both have, so a climatology meets every year.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..axes import Axis
from ..functions import calendar
from ..grid import Grid, common_atts
from ..shared import stored

#: Dimension tables up to this long are snapped on the driver, longer ones in tables, with the same result.
SNAP = 200_000


def matches(a: Grid, b: Grid) -> list[tuple[Axis, Axis]]:
    out, used = [], set()
    for x in a.axes:
        for y in b.axes:
            if y.name not in used and x.related(y):
                out.append((x, y))
                used.add(y.name)
                break
    return out


def _field_columns(axis: Axis) -> dict:
    """A time axis's fields as expressions: those that are its columns, or all that its coordinate has."""
    if len(axis.columns) > 1 or axis.columns[0] in calendar.FIELDS and axis.kind in ("time", "season"):
        return {c: F.col(c) for c in axis.columns}
    return calendar.fields(F.col(axis.columns[0]), axis.calendar or "standard")


def _snap(small: list, large: list, rtol: float) -> dict:
    """From each coordinate of the one to the nearest of the other within the tolerance."""
    out = {}
    for x in small:
        i = bisect_left(large, x)
        near = min(large[max(0, i - 1) : i + 1], key=lambda y: abs(y - x), default=None)
        if near is not None and abs(near - x) <= rtol * abs(near) + 1e-300:
            out[x] = near
    return out


def _snapped(small: DataFrame, large: DataFrame, col: str, rtol: float) -> DataFrame:
    """_snap in tables, (col, __to): both sides sorted by ranges; a range's neighbours outside it come from the ranges' ends."""
    v = F.col(col).cast("double")
    both = large.select(v.alias("__y"), F.lit(0).alias("__side")).unionByName(small.select(v.alias("__y"), F.lit(1).alias("__side"))).where("__y is not null and not isnan(__y)")
    ranged = stored(both.repartitionByRange("__y").withColumn("__part", F.spark_partition_id()))
    x = F.when(F.col("__side") == 0, F.col("__y"))
    ends = sorted(ranged.groupBy("__part").agg(F.min(x), F.max(x)).collect())
    outer = []
    for k, (part, _, _) in enumerate(ends):
        outer.append((part, next((e[2] for e in reversed(ends[:k]) if e[2] is not None), None), next((e[1] for e in ends[k + 1 :] if e[1] is not None), None)))
    beyond = small.sparkSession.createDataFrame(outer, "__part int, __before double, __after double")
    up = Window.partitionBy("__part").orderBy("__y", "__side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__part").orderBy(F.desc("__y"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.withColumns({"__lo": F.last(x, ignorenulls=True).over(up), "__hi": F.last(x, ignorenulls=True).over(down)}).where("__side = 1").join(F.broadcast(beyond), "__part")
    held = held.select("__y", F.coalesce("__lo", "__before").alias("__lo"), F.coalesce("__hi", "__after").alias("__hi"))
    far = F.col("__lo").isNull() | (F.col("__hi") - F.col("__y") < F.col("__y") - F.col("__lo"))
    held = held.select(F.col("__y").alias(col), F.when(far, F.col("__hi")).otherwise(F.col("__lo")).alias("__to"))
    return held.where(F.abs(F.col("__to") - F.col(col)) <= F.lit(rtol) * F.abs("__to") + F.lit(1e-300))


def _check(n: int, m: int, met: int, name: str) -> None:
    if met < min(n, m):
        raise ValueError(f"axis {name}: {n} and {m} coordinates meet in {met} only; one must hold all of the other's")


def aligned(a: Grid, b: Grid, check: bool = True) -> tuple[DataFrame, tuple[Axis, ...], list[str], list[str]]:
    """The joined cells, their axes, and the value columns of either side under names that don't clash."""
    left = a.df.select(*a.keys, *[F.col(v).alias(f"__l_{v}") for v in a.values])
    right = b.df.select(*b.keys, *[F.col(v).alias(f"__r_{v}") for v in b.values])
    on: list[str] = []
    axes = list(a.axes)
    pairs = matches(a, b)
    for x, y in pairs:
        partial = [len(z.columns) > 1 or z.kind in ("time", "season") for z in (x, y)]
        if x.is_a("time") and (any(partial) or x.calendar != y.calendar):
            f, h = _field_columns(x), _field_columns(y)
            names = [n for n in ((y if partial[1] else x).columns if any(partial) else calendar.FIELDS) if n in f and n in h]
            left, right = left.withColumns({f"__f_{n}": f[n] for n in names}), right.withColumns({f"__f_{n}": h[n] for n in names})
            if partial[0] and not partial[1]:
                axes[axes.index(x)] = y
                left = left.drop(*x.all_columns)
            else:
                right = right.drop(*y.all_columns)
            on += [f"__f_{n}" for n in names]
            continue
        renamed = dict(zip(y.columns, x.columns, strict=True))
        right = right.withColumnsRenamed(renamed).drop(*[c for c in y.aux if c in left.columns])
        if check or isinstance(left.schema[x.columns[0]].dataType, (T.DoubleType, T.FloatType)):
            right = _reconciled(left, right, x, check)
        on += x.columns
    mine = {y.name for _, y in pairs}
    axes += [y for y in b.axes if y.name not in mine]
    clash = [c for c in right.columns if c in left.columns and c not in on]
    joined = left.join(right.drop(*clash), on) if on else left.crossJoin(right)
    return joined, tuple(axes), [f"__l_{v}" for v in a.values], [f"__r_{v}" for v in b.values]


def _reconciled(left: DataFrame, right: DataFrame, axis: Axis, check: bool) -> DataFrame:
    cols = list(axis.columns)
    one, two = left.select(*cols).distinct(), right.select(*cols).distinct()
    floating = len(cols) == 1 and isinstance(left.schema[cols[0]].dataType, (T.DoubleType, T.FloatType))
    n, m = one.count(), two.count()
    if floating and max(n, m) <= SNAP:
        xs, ys = (sorted(r[0] for r in d.collect() if r[0] is not None) for d in (one, two))
        to = _snap(ys, xs, axis.rtol)
        if check:
            _check(len(xs), len(ys), len(set(to.values())), axis.name)
        moved = {y: x for y, x in to.items() if x != y}
        if moved:
            names = left.sparkSession.createDataFrame(list(moved.items()), f"`{cols[0]}` double, __to double")
            right = right.join(names, cols, "left").withColumn(cols[0], F.coalesce("__to", cols[0])).drop("__to")
        return right
    if floating:
        to = stored(_snapped(two, one, cols[0], axis.rtol))
        if check:
            _check(n, m, to.select("__to").distinct().count(), axis.name)
        return right.join(to, cols, "left").withColumn(cols[0], F.coalesce("__to", cols[0])).drop("__to")
    if check:
        _check(n, m, one.join(two, cols).count(), axis.name)
    return right


def binary(a: Grid, b, f, name: str | None = None, check: bool = True) -> Grid:
    """f of the values of two grids, cell by cell; axes that only one has spread over the other."""
    if not isinstance(b, Grid):
        return a.mapped(lambda c: f(c, b), {v: name or v for v in a.values} if len(a.values) == 1 else None)
    joined, axes, left, right = aligned(a, b, check)
    if len(left) != len(right) and 1 not in (len(left), len(right)):
        raise ValueError("grids with different numbers of values")
    n = max(len(left), len(right))
    pairs = [(left[i % len(left)], right[i % len(right)]) for i in range(n)]
    names = [name] if name and n == 1 else [p[0][4:] for p in pairs]
    keys = [c for x in axes for c in x.all_columns]
    out = joined.select(*keys, *[f(F.col(x), F.col(y)).alias(k) for (x, y), k in zip(pairs, names, strict=True)])
    return Grid(out, axes, tuple(names), common_atts(a.atts, b.atts))


def asof(left: DataFrame, right: DataFrame, key: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Each row of `left` with `columns` of the last row of `right` whose key isn't greater (of equal keys one)."""
    by = by or []
    both = left.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in columns], F.lit(1).alias("__side"))
    other = right.select(*[F.col(c) if c == key or c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *[F.col(c).alias(f"__{c}") for c in columns], F.lit(0).alias("__side"))
    own = F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in columns]))
    to_here = lambda *cols: Window.partitionBy(*cols).orderBy(key, "__side").rowsBetween(Window.unboundedPreceding, 0)
    if by:
        held = both.unionByName(other).withColumn("__held", F.last(own, ignorenulls=True).over(to_here(*by)))
    else:
        # ranges of the key; each hands its last row of `right` on to those after it, in a table of a row a range
        ranged = stored(both.unionByName(other).repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
        ends = ranged.groupBy("__part").agg(F.max_by(own, F.when(F.col("__side") == 0, F.col(key))).alias("__end"))
        before = F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        held = ranged.join(F.broadcast(ends.select("__part", before.alias("__before"))), "__part")
        held = held.withColumn("__held", F.coalesce(F.last(own, ignorenulls=True).over(to_here("__part")), "__before"))
    return held.where("__side = 1").select(*left.columns, *[F.col(f"__held.{c}").alias(c if c not in left.columns else f"{c}_right") for c in columns])


def rebased(time, from_start, to_start, from_unit: str = "days", to_unit: str = "days"):
    """Offsets from one start and unit as offsets from another; starts are seconds of one calendar."""
    units = calendar.UNITS
    return (time * units[from_unit] + (from_start - to_start)) / units[to_unit]
