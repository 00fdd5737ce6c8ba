"""Small deterministic grids for tutorials and tests, made of ranges on the cluster."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import axes as ax
from ..grid import Grid, grid


def _temperature(lat, lon):
    return 260 + 40 * F.exp(-F.pow(lat / 45.0, F.lit(2.0))) + 0.05 * lat * F.sin(6 * lon * math.pi / 180)


def surface(spark: SparkSession, nlat: int = 31, nlon: int = 60) -> Grid:
    df = ax.regularlat(spark, nlat).crossJoin(ax.regularlon(spark, nlon))
    return grid(df.withColumn("Temp", _temperature(F.col("lat"), F.col("lon"))), [ax.lat(), ax.lon()], "Temp")


def atmosphere(spark: SparkSession, days: int = 3650, levels: int = 20, nlat: int = 31, nlon: int = 60) -> Grid:
    """Temperature with a lapse and an annual cycle, and a wind, on a 365-day calendar from 2011."""
    times = ax.modeltimen(spark, "365", "2011-01-01", days)
    pres = spark.range(1, levels + 1).select((F.col("id") * 50.0).alias("pres"))
    df = times.crossJoin(pres).crossJoin(ax.regularlat(spark, nlat)).crossJoin(ax.regularlon(spark, nlon))
    year = 2 * math.pi * F.col("time") / (365.0 * 86400)
    temp = _temperature(F.col("lat"), F.col("lon")) + 20 * F.log10(F.col("pres") / 1000) - 5 * F.sin(year) * F.sin(F.radians("lat"))
    noise = (F.pmod(F.xxhash64("time", "pres"), F.lit(2001)) - 1000) / 1000.0
    wind = 40 * F.pow(F.sin(F.radians(2 * F.col("lat"))), F.lit(2.0)) * (1 - F.col("pres") / 1000) + noise
    return grid(df.withColumns({"Temp": temp, "U": wind}), [ax.time("time", "modeltime365"), ax.pres(), ax.lat(), ax.lon()], ["Temp", "U"])


def regression(spark: SparkSession, days: int = 200, nlat: int = 42, nlon: int = 60) -> Grid:
    """Three independent regressors and a response that is -0.2, 0.8 and -0.6 times them, with noise."""
    df = ax.standardtimen(spark, "2000-01-01", days).crossJoin(ax.gausslat(spark, nlat)).crossJoin(ax.regularlon(spark, nlon))
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), "time", "lat", "lon"), F.lit(200001)) - 100000) / 1e5
    df = df.withColumns({"X1": draw(1), "X2": draw(2), "X3": draw(3)})
    df = df.withColumn("Y", -0.2 * F.col("X1") + 0.8 * F.col("X2") - 0.6 * F.col("X3") + 0.1 * draw(4))
    return grid(df, [ax.time(), ax.Axis("lat", "lat", weights="lat_weight", aux=("lat_weight",), units="degrees_north"), ax.lon()], ["X1", "X2", "X3", "Y"])


def stations(spark: SparkSession, days: int = 10, n: int = 11) -> Grid:
    """Stations with their places as auxiliary columns."""
    who = spark.range(n).select(F.concat(F.lit("S"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("station"), (F.col("id") * 7.5 - 40).alias("lat"), (F.col("id") * 11.0).alias("lon"), (F.col("id") * 100).cast("int").alias("elevation"), F.element_at(F.array(F.lit("CA"), F.lit("NO"), F.lit("CL")), (F.col("id") % 3 + 1).cast("int")).alias("country"))
    df = ax.standardtimen(spark, "2009-01-01", days).crossJoin(who)
    v = F.datediff("time", F.lit("2009-01-01")) * n + F.substring("station", 2, 3).cast("int")
    return grid(df.withColumn("v", v.cast("double")), [ax.time(), ax.station("station", ("lat", "lon", "elevation", "country"))], "v")
