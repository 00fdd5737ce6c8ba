"""Axes: the coordinate columns of a grid and what is known of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each kind's parent.
KINDS = {
    "axis": "", "named": "axis", "dummy": "named", "xaxis": "axis", "yaxis": "axis", "zaxis": "axis", "taxis": "axis", "lon": "xaxis", "lat": "yaxis", "spectralm": "axis", "spectraln": "axis", "spectral": "axis",
    "height": "zaxis", "hybrid": "zaxis", "pres": "zaxis", "freq": "axis", "index": "axis", "coef": "index", "noncoordinate": "axis", "station": "noncoordinate", "event": "index", "offset": "axis", "ensemble": "index",
    "time": "taxis", "standardtime": "time", "modeltime365": "time", "modeltime360": "time", "yearless": "time", "season": "time", "lag": "yearless", "order": "index",
}
CALENDARS = {"standardtime": "standard", "modeltime365": "365", "modeltime360": "360", "yearless": "yearless", "lag": "yearless"}
#: Coordinate formats by kind.
FORMATS = {"lon": "%.3g E<360", "lat": "%.2g N", "height": "%d", "hybrid": "%g", "pres": "%.2g<100"}


def ancestry(kind: str) -> list[str]:
    out = [kind]
    while KINDS.get(out[-1]):
        out.append(KINDS[out[-1]])
    return out


@dataclass(frozen=True)
class Axis:
    """`columns` hold the coordinate: one column of the axis's name, or the fields of a time axis without some of them.

    weights: an SQL expression over the coordinate and auxiliary columns, None where the axis has none.
    aux: columns that travel with the coordinate. order: 1 or -1, the natural direction.
    """

    name: str
    kind: str = "axis"
    columns: tuple[str, ...] = ()
    units: str = ""
    weights: str | None = None
    aux: tuple[str, ...] = ()
    rtol: float = 1e-5
    order: int = 1
    atts: Mapping = field(default_factory=dict)

    def __post_init__(self):
        if not self.columns:
            object.__setattr__(self, "columns", (self.name,))
        if self.kind not in KINDS:
            raise ValueError(f"no such kind of axis: {self.kind}")

    @property
    def calendar(self) -> str | None:
        return self.atts.get("calendar") or next((CALENDARS[k] for k in ancestry(self.kind) if k in CALENDARS), None)

    @property
    def all_columns(self) -> tuple[str, ...]:
        return self.columns + tuple(a for a in self.aux if a not in self.columns)

    @property
    def coordinate(self) -> str:
        if len(self.columns) != 1:
            raise ValueError(f"axis {self.name} has the fields {self.columns}, not one coordinate")
        return self.columns[0]

    def is_a(self, kind: str) -> bool:
        return kind.lower() in ancestry(self.kind)

    def related(self, other: Axis) -> bool:
        """Whether one kind is an ancestor of the other; generic and named axes must have equal names too."""
        if not (self.is_a(other.kind) or other.is_a(self.kind)):
            return False
        return self.name == other.name if {self.kind, other.kind} & {"axis", "named", "dummy", "index", "noncoordinate"} else True

    def renamed(self, name: str) -> Axis:
        return replace(self, name=name, columns=(name,) if self.columns == (self.name,) else self.columns)


def lon(name: str = "lon", **k) -> Axis:
    return Axis(name, "lon", units="degrees_east", **k)


def lat(name: str = "lat", **k) -> Axis:
    return Axis(name, "lat", units="degrees_north", **({"weights": f"cos(radians(`{name}`))"} | k))


def pres(name: str = "pres", **k) -> Axis:
    return Axis(name, "pres", units="hPa", order=-1, **k)


def time(name: str = "time", kind: str = "standardtime", **k) -> Axis:
    return Axis(name, kind, **k)


def station(name: str = "station", aux: Sequence[str] = (), **k) -> Axis:
    return Axis(name, "station", aux=tuple(aux), **k)


# Dimension tables. Axes are small: what an axis holds is bounded by its length, not by the grid's cells.


def table(spark: SparkSession, columns: Mapping[str, Sequence]) -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(dict(columns)))


def regularlon(spark: SparkSession, n: int, origin: float = 0.0, repeat: bool = False) -> DataFrame:
    return table(spark, {"lon": origin + 360.0 / n * np.arange(n + repeat)})


def regularlat(spark: SparkSession, n: int, poles: bool = True, order: int = 1) -> DataFrame:
    """Evenly spaced from pole to pole; without the poles, the spacing is that with them."""
    v = np.linspace(-90, 90, n) if poles else 180.0 * np.arange(1, n + 1) / (n + 1) - 90
    return table(spark, {"lat": v[::order]})


def gausslat(spark: SparkSession, n: int, order: int = 1) -> DataFrame:
    """Gaussian latitudes with their quadrature weights."""
    x, w = np.polynomial.legendre.leggauss(n)
    return table(spark, {"lat": np.degrees(np.arcsin(x))[::order], "lat_weight": w[::order]})


def spectral(spark: SparkSession, truncation: int) -> DataFrame:
    """Pairs (n, m) of a triangular truncation."""
    pairs = [(n, m) for m in range(truncation + 1) for n in range(m, truncation + 1)]
    return table(spark, {"spectral": range(len(pairs)), "n": [p[0] for p in pairs], "m": [p[1] for p in pairs]})


def standardtimerange(spark: SparkSession, start: str, end: str, step: int = 1, units: str = "days", inc: bool = False) -> DataFrame:
    """Times from start to end, which is left out unless `inc`."""
    from .functions.calendar import timestamp_text

    every = f"interval {step} {units}"
    out = spark.sql(f"SELECT explode(sequence(timestamp_ntz '{timestamp_text(start)}', timestamp_ntz '{timestamp_text(end)}', {every})) AS time")
    return out if inc else out.where(f"time < timestamp_ntz '{timestamp_text(end)}'")


def standardtimen(spark: SparkSession, start: str, n: int, step: int = 1, units: str = "days") -> DataFrame:
    from .functions.calendar import timestamp_text

    return spark.range(n).select(F.expr(f"timestamp_ntz '{timestamp_text(start)}' + id * interval {step} {units}").alias("time"))


def modeltimen(spark: SparkSession, calendar: str, start: str | None, n: int, step: int = 1, units: str = "days") -> DataFrame:
    """`n` times of a 365-day, 360-day or yearless calendar, as seconds."""
    from .functions.calendar import UNITS, parse, seconds_of_fields

    first = seconds_of_fields({k: F.lit(v) for k, v in (parse(start) if start else {}).items()}, calendar)
    return spark.range(n).select((first + F.col("id") * (step * UNITS[units])).alias("time"))


def modeltimerange(spark: SparkSession, calendar: str, start: str, end: str, step: int = 1, units: str = "days", inc: bool = False) -> DataFrame:
    from .functions.calendar import UNITS, parse, seconds_of_fields

    a, b = (seconds_of_fields({k: F.lit(v) for k, v in parse(t).items()}, calendar) for t in (start, end))
    out = spark.range(1).select(F.explode(F.sequence(a, b, F.lit(step * UNITS[units]).cast("long"))).alias("time"), b.alias("__end"))
    return (out if inc else out.where("time < __end")).select("time")


def log_pressure(p: Column, p0: float = 1000.0, scale: float = 7.0) -> Column:
    """Height over pressure: scale * ln(p0 / p)."""
    return scale * F.log(p0 / p)


def _general(value: Column, digits: int) -> Column:
    """`%.{digits}g`."""
    magnitude = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    scaled = F.round(value / F.pow(F.lit(10.0), (magnitude - digits + 1).cast("double"))) * F.pow(F.lit(10.0), (magnitude - digits + 1).cast("double"))
    text = F.format_string("%.10f", scaled)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def formatted(axis: Axis, value: Column, fmt: str | None = None, units: bool = True) -> Column:
    """A coordinate as text: `%.3g` and the like, with `E` or `E<360` (hemisphere of longitudes), `N` (of latitudes),
    `<100` (pressures under 100 with a digit more)."""
    import re

    if axis.is_a("time"):
        from .functions.calendar import fields
        from .functions.calendar import formatted as time_text

        return time_text(fields(value, axis.calendar or "standard"), fmt or "$b $d, $Y $H:$M:$S", axis.calendar or "standard", value)
    fmt = fmt or FORMATS.get(axis.kind, "%g")
    m = re.match(r"%(?:\.(\d+))?([dg])(\s?)(E|N)?(?:<(\d+))?$", fmt)
    if not m:
        return F.format_string(fmt, value)
    digits, kind, gap, side, bound = m.groups()
    text = lambda v, n=int(digits or 6): v.cast("long").cast("string") if kind == "d" else _general(v, n)
    if side == "E":
        edge, v = int(bound or 180), F.pmod(value, F.lit(360.0))
        return F.when(v < edge, F.concat(text(v), F.lit(gap + "E"))).otherwise(F.concat(text(360 - v), F.lit(gap + "W")))
    if side == "N":
        return F.when(value > 0, F.concat(text(value), F.lit(gap + "N"))).when(value < 0, F.concat(text(-value), F.lit(gap + "S"))).otherwise("EQ")
    if bound:
        return F.concat(F.when(value < int(bound), text(value)).otherwise(value.cast("long").cast("string")), F.lit(f" {axis.units}" if units and axis.units else ""))
    return F.concat(text(value), F.lit(f" {axis.units}" if units and axis.units else ""))
