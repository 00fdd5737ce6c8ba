"""Grids made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import axes as ax
from ..grid import Grid, grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def li_day(spark: SparkSession, sf_dir: str) -> Grid:
    """Mean price by day and return flag."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(F.avg("l_extendedprice").alias("v"))
    return grid(df, [ax.time("day"), ax.Axis("flag", "named")], "v")


def li_cells(spark: SparkSession, sf_dir: str, values=("l_extendedprice",)) -> Grid:
    """Single items, on quantity, flag and status; the quantity's axis has weights."""
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus", *values)
    return grid(df, [ax.Axis("l_quantity", "yaxis", weights="cos(radians(l_quantity))"), ax.Axis("l_returnflag", "named"), ax.Axis("l_linestatus", "named")], values)


def holed(spark: SparkSession, sf_dir: str) -> Grid:
    """The same, with NaN at quantity 7 of flags A and N, and throughout status F of flag N."""
    g = li_cells(spark, sf_dir)
    hole = ((F.col("l_quantity") == 7) & (F.col("l_returnflag") != "R")) | ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"))
    return g.with_df(g.df.withColumn("l_extendedprice", F.when(hole, float("nan")).otherwise(F.col("l_extendedprice"))))


def emb(spark: SparkSession, sf_dir: str) -> Grid:
    """Vectors as lines of 64 places."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return grid(df.select("vec_id", "pos", F.col("v").cast("double").alias("v")), [ax.Axis("vec_id", "index"), ax.Axis("pos", "xaxis")], "v")


def ev(spark: SparkSession, sf_dir: str) -> Grid:
    return grid(table(spark, sf_dir, "events").select(F.col("ts").alias("time"), "event_type", "value"), [ax.time(), ax.Axis("event_type", "named")], "value")


def part(spark: SparkSession, sf_dir: str, by: str) -> Grid:
    df = table(spark, sf_dir, "part").groupBy(by).agg(F.avg("p_retailprice").alias(f"price_by_{by}"))
    return grid(df, [ax.Axis(by, "named")], f"price_by_{by}")


#: The same in SQL, as common table expressions.
SQL = {
    "li": "li AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)",
    "emb": "emb AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "ev": "ev AS (SELECT ts AS time, event_type, value FROM events)",
    "holed": "holed AS (SELECT l_quantity, l_returnflag, l_linestatus, CASE WHEN (l_quantity = 7 AND l_returnflag <> 'R') OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS v FROM lineitem)",
    "cells": "cells AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)",
}
