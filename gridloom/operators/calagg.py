"""Calendar aggregations: values of a time axis grouped by some of its fields. All are one partial and final aggregate.

Bins: `clim` (all fields but the year), `diurnal`, `daily`, `monthly`, `yearly`, `seasonal`. The result's time axis has
the bin's fields as its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions import calendar
from ..functions.npmath import nn, num
from ..grid import Grid
from .reduce import AGGREGATES

BINS = {"clim": ("month", "day", "hour", "minute", "second"), "diurnal": ("hour", "minute", "second"), "daily": ("year", "month", "day"), "monthly": ("year", "month"), "yearly": ("year",), "seasonal": ("year", "season")}


def bin_columns(g: Grid, axis: Axis, bins: str | Sequence[str], boundaries: str = "months") -> dict[str, Column]:
    """The bin's fields; a date without a time of day has no smaller fields."""
    cal = axis.calendar or "standard"
    f = calendar.fields(F.col(axis.coordinate), cal)
    if bins == "seasonal":
        year, season = calendar.season(f, boundaries)
        return {"year": year, "season": season}
    names = BINS[bins] if isinstance(bins, str) else tuple(bins)
    if bins == "clim" and (g.df.schema[axis.coordinate].dataType.typeName() == "date" or axis.atts.get("resolution") == "day"):
        names = ("month", "day")
    if cal == "yearless":
        names = tuple(n for n in names if n not in ("year", "month"))
    return {n: f[n] for n in names}


def calendar_bins(g: Grid, bins: str | Sequence[str], how: str | Callable = "mean", which="time", boundaries: str = "months", suffix: str = "") -> Grid:
    axis = g.axis(which)
    f = AGGREGATES[how] if isinstance(how, str) else how
    keys = bin_columns(g, axis, bins, boundaries)
    rest = [a for a in g.axes if a != axis]
    outer = [c for a in rest for c in a.all_columns]
    df = g.df.select(*outer, *[c.alias(n) for n, c in keys.items()], *g.values)
    names = {v: f"{v}{suffix}" for v in g.values}
    out = df.groupBy(*keys, *outer).agg(*[f(num(v), None).alias(names[v]) for v in g.values])
    time = Axis(axis.name, "season" if bins == "seasonal" else "time", tuple(keys), atts=dict(axis.atts))
    return Grid(out, (time, *rest), tuple(names.values()), g.atts)


def _op(name: str, bins: str, how: str):
    def run(g: Grid, which="time", **more) -> Grid:
        return calendar_bins(g, bins, how, which, **more)

    run.__name__ = run.__qualname__ = name
    run.__doc__ = f"`{how}` of the values of each {bins} bin."
    return run


_WORDS = {"clim": ("climatology", "nanclimatology", "climstdev", "climnanstdev", "climcount")} | {b: (f"{b}mean", f"{b}nanmean", f"{b}stdev", f"{b}nanstdev", f"{b}count") for b in BINS if b != "clim"}
#: All of them by name: climatology, nanclimatology, climstdev, ..., dailymean, dailynanmean, and so on.
OPERATIONS = {name: _op(name, bins, how) for bins, names in _WORDS.items() for name, how in zip(names, ("mean", "nanmean", "stdev", "nanstdev", "count"), strict=True)}
globals().update(OPERATIONS)


def seconds(column: str, kind: str, calendar_name: str) -> Column:
    c = F.col(column)
    if calendar_name in ("365", "360", "yearless") or kind in ("bigint", "int"):
        return c.cast("double")
    return F.unix_micros(c.cast("timestamp")) / 1e6


def _time(g: Grid, axis: Axis, start: Column | None) -> Column:
    """Seconds since `start`, or since the axis's first time."""
    own = seconds(axis.coordinate, g.df.schema[axis.coordinate].dataType.simpleString(), axis.calendar or "standard")
    return own - (start if start is not None else F.min(own).over(Window.partitionBy()))


def first_second(g: Grid, which="time") -> float:
    axis = g.axis(which)
    return g.df.agg(F.min(seconds(axis.coordinate, g.df.schema[axis.coordinate].dataType.simpleString(), axis.calendar or "standard"))).first()[0]


def climtrend(g: Grid, which="time", start: float | None = None) -> Grid:
    """For each climatological bin the line through its values over seconds since the start: intercept and slope."""
    axis = g.axis(which)
    t = _time(g, axis, F.lit(first_second(g, axis) if start is None else start))
    keys = bin_columns(g, axis, "clim")
    rest = [a for a in g.axes if a != axis]
    outer = [c for a in rest for c in a.all_columns]
    df = g.df.select(*outer, *[c.alias(k) for k, c in keys.items()], t.alias("__t"), g.value).groupBy(*keys, *outer)
    out = df.agg(F.regr_intercept(num(g.value), "__t").alias("intercept"), F.regr_slope(num(g.value), "__t").alias("slope"))
    return Grid(out, (Axis(axis.name, "time", tuple(keys), atts=dict(axis.atts)), *rest), ("intercept", "slope"), g.atts)


def from_trend(trend: Grid, times: DataFrame, which="time", column: str = "time", start: float = 0.0, name: str = "trend") -> Grid:
    """slope * t + intercept at each of the times."""
    axis = trend.axis(which)
    own = Axis(column, axis.atts.get("kind", "standardtime"), atts={**axis.atts, "resolution": "day"} if "hour" not in axis.columns else dict(axis.atts))
    f = calendar.fields(F.col(column), own.calendar or "standard")
    t = seconds(column, times.schema[column].dataType.simpleString(), own.calendar or "standard") - F.lit(start)
    keyed = times.select(column, *[f[k].alias(f"__f_{k}") for k in axis.columns], t.alias("__t")).distinct()
    bins = trend.df.withColumnsRenamed({k: f"__f_{k}" for k in axis.columns})
    out = keyed.join(bins, [f"__f_{k}" for k in axis.columns]).withColumn(name, F.col("slope") * F.col("__t") + F.col("intercept"))
    return Grid(out, (own, *[a for a in trend.axes if a != axis]), (name,), trend.atts).tidy()


def detrend(g: Grid, which="time") -> Grid:
    """Values less their bin's line: one window over the bins, no join."""
    axis = g.axis(which)
    t = _time(g, axis, F.lit(first_second(g, axis)))
    keys = bin_columns(g, axis, "clim")
    df = g.df.withColumns({**{f"__{k}": c for k, c in keys.items()}, "__t": t})
    w = Window.partitionBy(*g.outer(axis), *[f"__{k}" for k in keys])
    v = num(g.value)
    out = df.withColumn(g.value, v - (F.regr_slope(v, F.col("__t")).over(w) * F.col("__t") + F.regr_intercept(v, F.col("__t")).over(w)))
    return g.with_df(out).tidy()


def anomalies(g: Grid, which="time", skip_nan: bool = False) -> Grid:
    """Values less their climatology, as one window over the bins."""
    axis = g.axis(which)
    keys = bin_columns(g, axis, "clim")
    df = g.df.withColumns({f"__{k}": c for k, c in keys.items()})
    w = Window.partitionBy(*g.outer(axis), *[f"__{k}" for k in keys])
    out = df.withColumns({v: num(v) - (F.avg(nn(v)) if skip_nan else F.avg(num(v))).over(w) for v in g.values})
    return g.with_df(out).tidy()


def time_average(g: Grid, n: int, which="time") -> Grid:
    """Means of each `n` times in a row; what is left at the end makes a bin too."""
    from .index import indexed

    axis = g.axis(which)
    df = indexed(g, axis).withColumn("__bin", F.floor(F.col("__i") / n))
    out = df.groupBy("__bin", *g.outer(axis)).agg(F.min(axis.coordinate).alias(axis.coordinate), *[F.avg(num(v)).alias(v) for v in g.values])
    return Grid(out.drop("__bin"), g.axes, g.values, g.atts).tidy()


def remove_leap_days(g: Grid, which="time", leap: Sequence[int] = (60,), no_leap: Sequence[int] = ()) -> Grid:
    """Days of the year left out of leap years (and of others); what stays is numbered anew on a 365-day calendar."""
    axis = g.axis(which)
    f = calendar.fields(F.col(axis.coordinate), axis.calendar or "standard")
    doy, is_leap = calendar.day_of_year(f), calendar.is_leap(f["year"])
    gone = F.when(is_leap, doy.isin(list(leap)) if leap else F.lit(False)).otherwise(doy.isin(list(no_leap)) if no_leap else F.lit(False))
    before = lambda days: sum((F.when(doy > d, 1).otherwise(0) for d in days), F.lit(0))
    new = doy - F.when(is_leap, before(leap)).otherwise(before(no_leap))
    time = (f["year"].cast("long") * 365 + new - 1) * calendar.DAY + f["hour"] * 3600 + f["minute"] * 60 + f["second"]
    df = g.df.where(~gone).withColumn("__t", time.cast("long")).drop(*axis.all_columns).withColumnRenamed("__t", axis.name)
    return Grid(df, tuple(Axis(axis.name, "modeltime365", atts={k: v for k, v in axis.atts.items() if k != "calendar"}) if a == axis else a for a in g.axes), g.values, g.atts).tidy()


def step(g: Grid, which="time", allow_varying: bool = False) -> float:
    """Seconds between neighbouring times; several are an error unless the smallest is asked for."""
    axis = g.axis(which)
    s = seconds(axis.coordinate, g.df.schema[axis.coordinate].dataType.simpleString(), axis.calendar or "standard")
    t = g.df.select(s.alias("s")).distinct()
    gaps = t.select((F.col("s") - F.lag("s").over(Window.orderBy("s"))).alias("d")).agg(F.min("d"), F.max("d")).first()
    if gaps[0] != gaps[1] and not allow_varying:
        raise ValueError("the time axis has several steps")
    return gaps[0]


def modify_fields(g: Grid, which="time", keep: Sequence[str] = (), drop: Sequence[str] = ()) -> Grid:
    """The time axis with some of its fields only. Cells that become alike stay apart until they are reduced."""
    axis = g.axis(which)
    f = calendar.fields(F.col(axis.coordinate), axis.calendar or "standard")
    names = tuple(n for n in (keep or calendar.FIELDS) if n not in drop)
    rest = [c for a in g.axes if a != axis for c in a.all_columns]
    df = g.df.select(*rest, *[f[n].alias(n) for n in names], *g.values)
    return Grid(df, tuple(replace(a, columns=names, kind="time") if a == axis else a for a in g.axes), g.values, g.atts).tidy()


__all__ = ["BINS", "OPERATIONS", "calendar_bins", "climtrend", "from_trend", "detrend", "anomalies", "time_average", "remove_leap_days", "step", "modify_fields", "bin_columns", "first_second", *OPERATIONS]
