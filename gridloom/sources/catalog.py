"""Many files as one grid: all at once, by the dates in their names, or by what a manifest says they hold."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import Axis
from ..grid import Grid, grid
from ..operators.sets import concat, gaps, missing_dates
from .io import open_grid, read_table


def open_all(spark: SparkSession, paths: Sequence[str] | str, opener: Callable[..., Grid] | None = None, **how) -> Grid:
    """Every file's grid along the axis that differs. Without an opener one scan reads them all."""
    if opener is None:
        return open_grid(spark, paths, **how)
    return concat(*[opener(spark, p, **how) for p in ([paths] if isinstance(paths, str) else paths)])


def open_multi(spark: SparkSession, paths: Sequence[str] | str, pattern: str, axes: Sequence[Axis], values: Sequence[str] | str, fmt: str = "parquet", between: tuple[str, str] | None = None, **options) -> Grid:
    """Files whose names hold dates by named groups (`(?P<year>\\d{4})(?P<month>\\d\\d)...`).

    `between` (two dates) prunes files by name before any is opened; the table keeps the file's date as `file_date`.
    """
    compiled = re.compile(pattern)
    df = read_table(spark, paths, fmt, **options)
    group = lambda n: F.regexp_extract("_metadata.file_name", re.sub(r"\?P<\w+>", "", pattern), compiled.groupindex[n]).cast("int") if n in compiled.groupindex else F.lit(1)
    if between is not None:
        lo, hi = between
        files = [f for f in df.inputFiles() if _file_date(compiled, f) is None or lo <= _file_date(compiled, f) <= hi]
        df = read_table(spark, files, fmt, **options) if files else df.where(F.lit(False))
    df = df.withColumn("file_date", F.make_date(group("year"), group("month"), group("day")))
    return grid(df, axes, values)


def _file_date(pattern: re.Pattern, path: str) -> str | None:
    m = pattern.search(path.rsplit("/", 1)[-1])
    if not m:
        return None
    g = {"year": 1, "month": 1, "day": 1} | {k: int(v) for k, v in m.groupdict().items() if v and k in ("year", "month", "day")}
    return f"{g['year']:04d}-{g['month']:02d}-{g['day']:02d}"


def check_multi(df: DataFrame, time: str, expected: Mapping[str, str] | None = None, step_days: int = 1) -> dict[str, DataFrame | list[str]]:
    """What is wrong with a table of many files: gaps, missing dates, repeated times, and missing, extra or other columns."""
    out: dict = {"gaps": gaps(df, time, step_days), "missing_dates": missing_dates(df, time)}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if expected is not None:
        out |= {"missing": [c for c in expected if c not in have], "extra": [c for c in have if c not in expected], "mismatched": [c for c, k in expected.items() if c in have and have[c] != k]}
    return out


def manifest(df: DataFrame, axes: Sequence[Axis], variables: Sequence[str]) -> DataFrame:
    """What each file holds: path, variable, axis, and the sorted coordinates as text."""
    long = df.select(F.col("_metadata.file_path").alias("path"), *[F.col(a.coordinate).cast("string").alias(a.name) for a in axes], *variables)
    parts = []
    for v in variables:
        held = long.where(F.col(v).isNotNull())
        for a in axes:
            parts.append(held.groupBy("path").agg(F.array_sort(F.collect_set(a.name)).alias("coordinates")).select("path", F.lit(v).alias("variable"), F.lit(a.name).alias("axis"), "coordinates"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def domains(m: DataFrame) -> DataFrame:
    """Files of a variable that agree on every axis but one are one domain: the union along it, by variable."""
    signature = m.groupBy("variable", "path").agg(F.array_sort(F.collect_list(F.struct("axis", "coordinates"))).alias("axes"))
    return signature.groupBy("variable").agg(F.collect_list("path").alias("paths"), F.collect_set("axes").alias("axes"))


def coverage(m: DataFrame, axis: str) -> DataFrame:
    """Coordinates that all variables hold, and those that some do."""
    per = m.where(F.col("axis") == axis).groupBy("variable").agg(F.array_distinct(F.flatten(F.collect_list("coordinates"))).alias("c"))
    return per.agg(F.expr("aggregate(slice(collect_list(c), 2, 2147483647), element_at(collect_list(c), 1), (a, b) -> array_intersect(a, b))").alias("shared"), F.array_distinct(F.flatten(F.collect_list("c"))).alias("any"))


@dataclass(frozen=True)
class Catalog:
    """Grids with the properties that searches rank them by. It holds plans, not cells."""

    entries: tuple[tuple[Mapping, Grid], ...]

    def have(self, **needed) -> bool:
        return bool(self.find(**needed))

    def find(self, **needed) -> list[Grid]:
        return [g for p, g in self.entries if all(callable(v) and v(p.get(k)) or p.get(k) == v for k, v in needed.items())]

    def find_best(self, maximize: Sequence[Callable[[Mapping], float]] = (), minimize: Sequence[Callable[[Mapping], float]] = (), **needed) -> Grid | None:
        some = [(p, g) for p, g in self.entries if all(callable(v) and v(p.get(k)) or p.get(k) == v for k, v in needed.items())]
        ranked = sorted(some, key=lambda e: (*[-f(e[0]) for f in maximize], *[f(e[0]) for f in minimize]))
        return ranked[0][1] if ranked else None
