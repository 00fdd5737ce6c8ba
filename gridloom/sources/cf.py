"""Metadata conventions: what attributes say about axes and values, and attributes from axes.

A description is a dict: variables' attributes by name (`units`, `standard_name`, `axis`, `calendar`, `scale_factor`,
`add_offset`, `_FillValue`, `missing_value`, `ancillary_variables`), as any reader of a file format may give it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.npmath import NAN, num
from ..grid import Grid, grid

_KIND_BY_NAME = {"latitude": "lat", "longitude": "lon", "air_pressure": "pres", "height": "height", "time": "standardtime", "atmosphere_hybrid_sigma_pressure_coordinate": "hybrid"}
_KIND_BY_AXIS = {"X": "xaxis", "Y": "yaxis", "Z": "zaxis", "T": "taxis"}
_CALENDAR = {"standard": "standardtime", "gregorian": "standardtime", "proleptic_gregorian": "standardtime", "noleap": "modeltime365", "365_day": "modeltime365", "360_day": "modeltime360", "none": "yearless"}
_SINCE = re.compile(r"^\s*(second|minute|hour|day)s?\s+since\s+(.+?)\s*$", re.I)


def kind_of(atts: Mapping) -> str:
    units = str(atts.get("units", ""))
    if _SINCE.match(units):
        return _CALENDAR.get(str(atts.get("calendar", "standard")).lower(), "standardtime")
    if atts.get("standard_name") in _KIND_BY_NAME:
        return _KIND_BY_NAME[atts["standard_name"]]
    if re.fullmatch(r"degrees?_?(n|north)", units, re.I):
        return "lat"
    if re.fullmatch(r"degrees?_?(e|east)", units, re.I):
        return "lon"
    if units.lower() in ("hpa", "mb", "mbar", "millibar", "millibars", "pa"):
        return "pres"
    return _KIND_BY_AXIS.get(str(atts.get("axis", "")).upper(), "axis")


def unpacked(c: Column, atts: Mapping) -> Column:
    """Fill values become NaN, then scale and offset apply."""
    fills = [float(atts[k]) for k in ("_FillValue", "missing_value") if k in atts]
    v = num(c)
    if "scale_factor" in atts or "add_offset" in atts:
        v = v * float(atts.get("scale_factor", 1.0)) + float(atts.get("add_offset", 0.0))
    return F.when(num(c).isin(fills), NAN).otherwise(v) if fills else v


def _time(c: Column, units: str, calendar: str) -> Column:
    from ..functions.calendar import UNITS, parse, seconds_of_fields, timestamp_text

    unit, start = _SINCE.match(units).groups()
    seconds = F.round(num(c) * UNITS[unit.lower() + "s"]).cast("long")
    start = start.replace("Z", "").split(".")[0]
    if calendar == "standardtime":
        return F.timestamp_seconds(seconds + F.unix_seconds(F.lit(timestamp_text(start)).cast("timestamp"))).cast("timestamp_ntz")
    return seconds + seconds_of_fields({k: F.lit(v) for k, v in parse(start).items()}, {"modeltime365": "365", "modeltime360": "360", "yearless": "yearless"}[calendar])


def decode(df: DataFrame, atts: Mapping[str, Mapping], coordinates: list[str], values: list[str], ignore: tuple[str, ...] = ()) -> Grid:
    """A typed grid from a long table and its variables' attributes."""
    axes, cols = [], []
    for name in coordinates:
        a = dict(atts.get(name, {})) if name not in ignore else {}
        kind = kind_of(a)
        c = F.col(name)
        if _SINCE.match(str(a.get("units", ""))):
            c = _time(c, a["units"], kind)
        aux = tuple(n for n in str(a.get("ancillary_variables", "")).split() if n in df.columns)
        cols += [c.alias(name), *[F.col(n) for n in aux]]
        weights = f"cos(radians(`{name}`))" if kind == "lat" else None
        axes.append(Axis(name, kind, units=str(a.get("units", "")), aux=aux, weights=weights, order=-1 if kind == "pres" else 1, atts={k: v for k, v in a.items() if k not in ("units", "axis", "ancillary_variables", "calendar")}))
    cols += [unpacked(F.col(v), atts.get(v, {}) if v not in ignore else {}).alias(v) for v in values]
    return grid(df.select(*cols), axes, values, {k: v for k, v in atts.get(values[0], {}).items() if k not in ("scale_factor", "add_offset", "_FillValue", "missing_value")} if len(values) == 1 else {})


def fix_name(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return out if re.match(r"[A-Za-z]", out) else f"v_{out}"


_STANDARD = {"lat": ("latitude", "Y"), "lon": ("longitude", "X"), "pres": ("air_pressure", "Z"), "height": ("height", "Z"), "hybrid": ("atmosphere_hybrid_sigma_pressure_coordinate", "Z")}


def encode(g: Grid, start: str = "1970-01-01") -> tuple[DataFrame, dict[str, dict]]:
    """A plain long table (times as days since `start`) and the attributes that `decode` reads."""
    from ..functions.calendar import parse, seconds_of_fields, timestamp_text

    atts: dict[str, dict] = {}
    cols = []
    for a in g.axes:
        name = fix_name(a.name)
        own = {k: v for k, v in a.atts.items() if isinstance(v, (str, int, float))}
        c = F.col(a.columns[0])
        if a.is_a("time") and len(a.columns) == 1 and a.calendar:
            own |= {"units": f"days since {start}", "axis": "T", "calendar": {"standard": "standard", "365": "365_day", "360": "360_day", "yearless": "none"}[a.calendar], "standard_name": "time"}
            if a.calendar == "standard":
                c = (F.unix_seconds(c.cast("timestamp")) - F.unix_seconds(F.lit(timestamp_text(start)).cast("timestamp"))) / 86400.0
            else:
                c = (c - seconds_of_fields({k: F.lit(v) for k, v in parse(start).items()}, a.calendar)) / 86400.0
        elif a.kind in _STANDARD:
            own |= {"units": a.units, "standard_name": _STANDARD[a.kind][0], "axis": _STANDARD[a.kind][1]}
        elif a.units:
            own["units"] = a.units
        if a.aux:
            own["ancillary_variables"] = " ".join(map(fix_name, a.aux))
        atts[name] = own
        cols += [c.alias(name), *[F.col(x).alias(fix_name(x)) for x in a.aux if x not in a.columns]]
        cols += [F.col(x).alias(fix_name(x)) for x in a.columns[1:]]
    for v in g.values:
        atts[fix_name(v)] = {k: x for k, x in g.atts.items() if isinstance(x, (str, int, float))}
        cols.append(F.col(v).alias(fix_name(v)))
    return g.df.select(*cols), atts


def packing_of(g: Grid) -> tuple[float, float]:
    """Scale and offset that spread the values over 16 bits."""
    from ..functions.npmath import nn

    lo, hi = g.df.agg(F.min(nn(g.value)), F.max(nn(g.value))).first()
    return ((hi - lo) / (2**16 - 2) or 1.0, (lo + hi) / 2) if lo is not None else (1.0, 0.0)


FILL = -(2**15)


def packed(g: Grid, scale: float | None = None, offset: float | None = None) -> tuple[Grid, dict]:
    """Values as 16-bit whole numbers, NaN as the fill value, with the attributes to unpack them."""
    if scale is None or offset is None:
        scale, offset = packing_of(g)
    c = num(g.value)
    short = F.when(F.isnan(c), F.lit(FILL)).otherwise(((c - offset) / scale).cast("int")).cast("short")
    return g.with_df(g.df.withColumn(g.value, short)), {"scale_factor": scale, "add_offset": offset, "_FillValue": FILL}
