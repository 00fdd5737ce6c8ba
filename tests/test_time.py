"""Calendars and calendar aggregations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import axes as ax
from gridloom.functions import calendar
from gridloom.operators import calagg, shape
from gridloom.sources import synthetic


def counted(days, calendar_name):
    """Year, month and day of each of so many days from year -5 on, by counting."""
    lengths = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    y, m, d = -5, 1, 1
    for _ in range(days):
        yield y, m, d
        leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
        last = 30 if calendar_name == "360" else lengths[m - 1] + (m == 2 and leap and calendar_name == "standard")
        d += 1
        if d > last:
            d, m = 1, m + 1
        if m > 12:
            m, y = 1, y + 1


@pytest.mark.parametrize("name", ["standard", "365", "360"])
def test_fields_by_counting(spark, name):
    n = 4200
    start = {"standard": -(5 * 365 + 1), "365": -5 * 365, "360": -5 * 360}[name]
    df = spark.range(n).select(((F.col("id") + start) * 86400 + 3661).alias("s"))
    f = calendar.fields_of_seconds(F.col("s"), name)
    got = df.select(*f.values(), calendar.seconds_of_fields(f, name) == F.col("s"), calendar.day_of_year(f, name)).orderBy("s").collect()
    assert [tuple(r[:3]) for r in got] == list(counted(n, name))
    assert all(tuple(r[3:6]) == (1, 1, 1) and r[6] for r in got)


def test_far_dates_and_wrapped_months(spark):
    r = spark.range(1).select(*[calendar.seconds_of_fields({k: F.lit(v) for k, v in zip(("year", "month", "day"), d)}, c) / 86400 for c, d in (("standard", (2000, 14, 1)), ("365", (0, 0, 1)), ("360", (1, 13, 30)), ("standard", (1980, 1, -4)))]).first()
    assert r[0] == dt.date(2001, 2, 1).toordinal() + 365 and r[1] == -31 and r[2] == 749
    assert r[3] == dt.date(1979, 12, 27).toordinal() + 365


def test_parse_and_format(spark):
    assert calendar.parse("12:30 1 Mar 2000") == {"hour": 12, "minute": 30, "day": 1, "month": 3, "year": 2000}
    assert calendar.parse("2004-060") == {"year": 2004, "month": 2, "day": 29} and calendar.parse("2003-060") == {"year": 2003, "month": 3, "day": 1}
    assert calendar.parse("2003-07") == {"year": 2003, "month": 7} and calendar.timestamp_text("Jan 18, 2011 06:00") == "2011-01-18 06:00:00"
    with pytest.raises(ValueError):
        calendar.parse("some day")
    s = calendar.seconds_of_fields({k: F.lit(v) for k, v in calendar.parse("06:05 18 Jan 2011").items()}, "365")
    f = calendar.fields_of_seconds(s, "365")
    got = spark.range(1).select(calendar.formatted(f), calendar.formatted(f, "$d/$m/$y $$ $I$p", "365"), calendar.encoded(f), calendar.days_in_month(f)).first()
    assert tuple(got) == ("Jan 18, 2011 06:05:00", "18/1/11 $ 6am", 20110118, 31)


def test_monthly_counts_of_a_365_day_year(spark):
    g = gl.grid(ax.modeltimen(spark, "365", "2000-01-01", 365).withColumn("v", F.lit(1.0)), [ax.time("time", "modeltime365")], "v")
    got = calagg.calendar_bins(g, "monthly", "sum").get()
    assert got["v"].tolist() == [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    assert g.monthlymean().atts == g.atts and calagg.step(g) == 86400
    assert g(time=("2000-02-01", "2000-02-28")).df.count() == 28 and g(month=3).df.count() == 31


def test_seasons(spark):
    df = spark.sql("SELECT explode(sequence(date'1999-12-01', date'2001-02-28', interval 1 day)) AS t")
    f = calendar.fields(F.col("t"))
    got = {r.t: ((r.a, r.b), (r.c, r.d)) for r in df.select("t", *[c.alias(n) for n, c in zip("abcd", (*calendar.season(f), *calendar.season(f, "leap")))]).collect()}
    assert got[dt.date(1999, 12, 1)][0] == (2000, 1) and got[dt.date(2000, 2, 29)][0] == (2000, 1) and got[dt.date(2000, 11, 30)][0] == (2000, 4)
    assert got[dt.date(2000, 2, 29)][1][1] == 2 and got[dt.date(2000, 5, 31)][1][1] == 3 and got[dt.date(2000, 8, 31)][1][1] == 4 and got[dt.date(2000, 11, 30)][1] == (2001, 1)
    assert spark.range(1).select(calendar.season_centre(F.lit(2001), F.lit(1))).first()[0] == dt.date(2001, 1, 15)


def test_climatology_and_anomalies(spark):
    g = synthetic.atmosphere(spark, 730, 1, 1, 1)
    u = gl.Grid(g.df.select(*g.keys, "U"), g.axes, ("U",))
    clim = u.climatology()
    assert clim.df.count() == 365 and clim.axis("time").columns[:2] == ("month", "day")
    a, b = (u - clim).get(), u.anomalies().get()
    np.testing.assert_allclose(a.sort_values("time")["U"], b.sort_values("time")["U"], atol=1e-12)
    assert abs(a["U"].mean()) < 1e-12


def test_trend_round_trip(spark):
    days = ax.standardtimerange(spark, "2001-01-01", "2011-01-01")
    g = gl.grid(days.withColumn("v", 3.0 + F.datediff("time", F.lit("2001-01-01")) * 0.01), [ax.time(atts={"resolution": "day"})], "v")
    t = g.climtrend()
    one = t.df.where("month = 7 and day = 4").first()
    assert one.slope * 86400 == pytest.approx(0.01) and one.intercept == pytest.approx(3.0)
    assert np.nanmax(np.abs(g(year=(2001, 2009), n_day=29).detrend().get()["v"])) < 1e-6
    back = t.from_trend(g.df, start=calagg.first_second(g))
    both = back.df.join(g.df, "time").where("trend is not null")
    assert both.agg(F.max(F.abs(F.col("trend") - F.col("v")))).first()[0] < 1e-6


def test_split_and_join(spark):
    g = synthetic.stations(spark, 800, 2)
    two = shape.split_time(g)
    assert two.df.where("month = 2 and day = 29").count() == 0 or two.df.where("isnan(v)").count() > 0
    back = shape.join_time(two, "year", "time_of_year")
    assert back.df.where("not isnan(v)").count() == g.df.count()


def test_leap_days_and_fields(spark):
    g = gl.grid(ax.standardtimerange(spark, "2003-01-01", "2005-01-01").withColumn("v", F.lit(1.0)), [ax.time()], "v")
    out = g.remove_leap_days()
    assert out.df.count() == 730 and out.axis("time").calendar == "365" and calagg.step(out) == 86400
    assert calagg.modify_fields(g, keep=("month",)).df.columns == ["month", "v"]
    assert g.time_average(10).df.count() == 74
    with pytest.raises(ValueError):
        calagg.step(g(n_month=2))
    assert calagg.step(g(n_month=2), allow_varying=True) == 86400


def test_mixed_units(spark):
    from gridloom.operators.align import rebased

    got = spark.range(1).select(rebased(F.lit(240), F.lit(0), F.lit(3600), "minutes", "hours")).first()[0]
    assert got == 3.0
