"""Calendars as Column arithmetic: fields from seconds, seconds from fields, truncation, seasons, formats, parsing.

Kinds: `standard` (proleptic Gregorian, year 0 a leap year), `365`, `360` and `yearless`. Standard times on the grid
are `timestamp_ntz` or `date` columns; times of model calendars, and standard times before year 1, are whole seconds
since the start of year 0. No Python runs on rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("year", "month", "day", "hour", "minute", "second")
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
SEASONS = ("DJF", "MAM", "JJA", "SON")
_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Days before each month of a 365-day year.
BEFORE = [sum(_LENGTHS[:m]) for m in range(12)]
DAY = 86400


def _div(a: Column, n: int) -> Column:
    """Floor division of whole numbers."""
    return F.expr("cast(0 as bigint)") + ((a - F.pmod(a, F.lit(n))) / n).cast("long")


def _month_of(doy: Column) -> Column:
    """1 to 12 from the day of a 365-day year, counted from 0."""
    return F.size(F.filter(F.array(*map(F.lit, BEFORE)), lambda b: b <= doy))


def _before(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BEFORE)), month.cast("int"))


def is_leap(year: Column) -> Column:
    return (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))


#: Days from 0000-01-01 to 1970-01-01.
EPOCH = 719528


def _civil(days: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of the days since 0000-01-01. The JVM's dates have a leap year 0 and years before it; such
    dates never leave it."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), (days - EPOCH).cast("int"))
    return F.year(date), F.month(date), F.dayofmonth(date)


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 0000-01-01. Days outside the month run on."""
    return F.unix_date(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))).cast("long") + EPOCH + day - 1


def fields_of_seconds(seconds: Column, calendar: str = "standard") -> dict[str, Column]:
    """Year, month, day (yearless: day only, from 0), hour, minute and second."""
    s = seconds.cast("long")
    days, rest = _div(s, DAY), F.pmod(s, F.lit(DAY))
    out = {"hour": _div(rest, 3600), "minute": F.pmod(_div(rest, 60), F.lit(60)), "second": F.pmod(rest, F.lit(60))}
    if calendar == "yearless":
        head = {"day": days}
    elif calendar == "360":
        doy = F.pmod(days, F.lit(360))
        head = {"year": _div(days, 360), "month": _div(doy, 30) + 1, "day": F.pmod(doy, F.lit(30)) + 1}
    elif calendar == "365":
        doy = F.pmod(days, F.lit(365))
        month = _month_of(doy)
        head = {"year": _div(days, 365), "month": month, "day": doy - _before(month) + 1}
    else:
        head = dict(zip(("year", "month", "day"), _civil(days), strict=True))
    return {k: c.cast("int") for k, c in (head | out).items()}


def seconds_of_fields(fields: Mapping[str, Column], calendar: str = "standard") -> Column:
    """The inverse. Months outside 1 to 12 run on into other years; fields not given are at their least."""
    f = {k: fields[k].cast("long") if k in fields else F.lit(1 if k in ("month", "day") and calendar != "yearless" else 0).cast("long") for k in FIELDS}
    clock = f["hour"] * 3600 + f["minute"] * 60 + f["second"]
    year, month = f["year"] + _div(f["month"] - 1, 12), F.pmod(f["month"] - 1, F.lit(12)) + 1
    if calendar == "yearless":
        days = f["day"]
    elif calendar == "360":
        days = year * 360 + (month - 1) * 30 + f["day"] - 1
    elif calendar == "365":
        days = year * 365 + _before(month) + f["day"] - 1
    else:
        days = _days(year, month, f["day"])
    return days * DAY + clock


def fields(time: Column, calendar: str = "standard") -> dict[str, Column]:
    """Fields of a coordinate: a timestamp or date of the standard calendar, seconds of another."""
    if calendar in ("365", "360", "yearless", "seconds"):
        return fields_of_seconds(time, "standard" if calendar == "seconds" else calendar)
    return {"year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time), "hour": F.hour(time), "minute": F.minute(time), "second": F.second(time)}


def day_of_year(f: Mapping[str, Column], calendar: str = "standard") -> Column:
    if calendar == "360":
        return (f["month"] - 1) * 30 + f["day"]
    leap = F.when((f["month"] > 2) & is_leap(f["year"]), 1).otherwise(0) if calendar != "365" else F.lit(0)
    return (_before(f["month"]) + f["day"] + leap).cast("int")


def days_in_month(f: Mapping[str, Column], calendar: str = "standard") -> Column:
    if calendar == "360":
        return F.lit(30)
    n = F.element_at(F.array(*map(F.lit, _LENGTHS)), f["month"].cast("int"))
    return n if calendar == "365" else n + F.when((f["month"] == 2) & is_leap(f["year"]), 1).otherwise(0)


def season(f: Mapping[str, Column], boundaries: str = "months") -> tuple[Column, Column]:
    """(year, season 1 to 4 from DJF); December counts to the next year.

    `boundaries="leap"`: seasons by the day of a leap year, so that the last days of February 29, May, August and
    November fall into the season that follows.
    """
    if boundaries == "months":
        return (f["year"] + F.when(f["month"] == 12, 1).otherwise(0)).cast("int"), (F.floor(F.pmod(f["month"], F.lit(12)) / 3) + 1).cast("int")
    doy = _before(f["month"]) + f["day"] + F.when(f["month"] > 2, 1).otherwise(0)
    index = F.when(doy < 60, 1).when(doy < 152, 2).when(doy < 244, 3).when(doy < 335, 4).otherwise(1)
    return (f["year"] + F.when(doy >= 335, 1).otherwise(0)).cast("int"), index.cast("int")


def season_centre(year: Column, index: Column) -> Column:
    """The middle day of a season: the 15th of its second month."""
    return F.make_date(year.cast("int"), (index * 3 - 2).cast("int"), F.lit(15))


def encoded(f: Mapping[str, Column], hours: bool = False) -> Column:
    """yyyymmdd, or yyyymmddhh, as a whole number."""
    date = f["year"].cast("long") * 10000 + f["month"] * 100 + f["day"]
    return date * 100 + f["hour"] if hours else date


def decoded(number: Column, hours: bool = False) -> dict[str, Column]:
    n = number.cast("long")
    day = _div(n, 100) if hours else n
    out = {"year": _div(day, 10000), "month": F.pmod(_div(day, 100), F.lit(100)), "day": F.pmod(day, F.lit(100))}
    return out | ({"hour": F.pmod(n, F.lit(100))} if hours else {})


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def formatted(f: Mapping[str, Column], fmt: str = "$b $d, $Y $H:$M:$S", calendar: str = "standard", value: Column | None = None) -> Column:
    """Text from fields. Codes: $b $B month's name, $d $D day, $H $I hour, $j day of the year, $m month, $M minute,
    $p $P half of the day, $S second, $y $a $Y year, $s season's name, $v $V the value itself, $$ a dollar sign."""
    name = lambda n: F.element_at(F.array(*[F.lit(m[:n]) for m in MONTHS]), f["month"].cast("int"))
    codes = {
        "b": lambda: name(3), "B": lambda: name(20), "d": lambda: f["day"].cast("string"), "D": lambda: _two(f["day"]), "H": lambda: _two(f["hour"]), "I": lambda: (F.pmod(f["hour"] + 11, F.lit(12)) + 1).cast("string"),
        "j": lambda: day_of_year(f, calendar).cast("string"), "m": lambda: f["month"].cast("string"), "M": lambda: _two(f["minute"]), "p": lambda: F.when(f["hour"] < 12, "am").otherwise("pm"), "P": lambda: F.when(f["hour"] < 12, "AM").otherwise("PM"),
        "S": lambda: _two(f["second"]), "y": lambda: _two(F.pmod(f["year"], F.lit(100))), "a": lambda: F.lpad(f["year"].cast("string"), 4, "0"),
        "Y": lambda: F.when(f["year"] < 100, F.concat(F.lit("y"), f["year"].cast("string"))).otherwise(f["year"].cast("string")),
        "s": lambda: F.element_at(F.array(*map(F.lit, SEASONS)), season(f)[1]), "v": lambda: value.cast("long").cast("string"), "V": lambda: value.cast("string"), "$": lambda: F.lit("$"),
    }
    parts = [codes[p[1]]() if p[0] == "$" and p[1:] in codes else F.lit(p) for p in re.findall(r"\$.|[^$]+", fmt)]
    return F.concat(*parts)


_DATES = (
    re.compile(r"^\s*(?:(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?\s+)?(?P<day>\d{1,2})\s+(?P<month>[A-Za-z]+)\.?,?\s+(?P<year>-?\d+)\s*$"),
    re.compile(r"^\s*(?P<month>[A-Za-z]+)\.?\s+(?P<day>\d{1,2}),?\s+(?P<year>-?\d+)(?:\s+(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?)?\s*$"),
    re.compile(r"^\s*(?P<year>-?\d{1,4})-(?P<doy>\d{3})\s*$"),
    re.compile(r"^\s*(?P<year>-?\d{1,4})(?:-(?P<month>\d{1,2})(?:-(?P<day>\d{1,2})(?:[T ](?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2}))?)?)?)?\s*$"),
)


def parse(text: str) -> dict[str, int]:
    """Fields of `[HH:MM[:SS]] D Month YYYY`, `Month D, YYYY`, `YYYY[-MM[-DD[THH:MM[:SS]]]]` or `YYYY-DDD`; on the driver."""
    for pattern in _DATES:
        m = pattern.match(text)
        if not m:
            continue
        got = {k: v for k, v in m.groupdict().items() if v is not None}
        if "month" in got and not got["month"].isdigit():
            found = [i for i, name in enumerate(MONTHS, 1) if name.lower().startswith(got["month"].lower()[:3])]
            if not found:
                continue
            got["month"] = found[0]
        out = {k: int(v) for k, v in got.items()}
        if "doy" in out:
            doy, year = out.pop("doy"), out["year"]
            leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
            starts = [b + (leap and i > 1) for i, b in enumerate(BEFORE)]
            out["month"] = sum(s < doy for s in starts)
            out["day"] = doy - starts[out["month"] - 1]
        return out
    raise ValueError(f"not a date: {text!r}")


def timestamp_text(text: str) -> str:
    """A date text of any of these forms as an SQL timestamp."""
    d = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0} | parse(text)
    return f"{d['year']:04d}-{d['month']:02d}-{d['day']:02d} {d['hour']:02d}:{d['minute']:02d}:{d['second']:02d}"
