"""Every query with SQL against DuckDB, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or v is pd.NaT:
            return "null"
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


ODD = [None, math.nan, math.inf, -0.0, 0.0, 0.05, 0.1234567891, 25.0, 25.00000001, 50.0]


def bits(rows):
    """Rows that tell null from NaN and -0.0 from 0.0."""
    return sorted(tuple(map(repr, r)) for r in rows)


def on_cells(name, spark, path, qs, ds, ts):
    """The query's rows over all cells of these values, and its SQL's."""
    cells = [(q, d, t) for q in qs for d in ds for t in ts]
    spark.createDataFrame(cells, "l_quantity double, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, str(path)), con.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns
    return bits(map(tuple, got.collect())), bits(want.fetchall())


@pytest.mark.parametrize("name", ["ufunc_div_zero", "ufunc_log_zero"])
def test_odd_cells(name, spark, tmp_path):
    got, want = on_cells(name, spark, tmp_path, ODD, ODD, ODD)
    assert got == want


@pytest.mark.parametrize("name", ["ufunc_arith", "ufunc_complex_many", "ufunc_div_zero", "ufunc_floor_mod", "ufunc_log_zero", "ufunc_minmax_nan", "ufunc_trig_deg"])
def test_cells_of_many_digits(name, spark, tmp_path):
    """Columns that the SQL doesn't round aren't rounded."""
    small = [None, 0.0, 0.05, 0.0123456789]
    got, want = on_cells(name, spark, tmp_path, [None, 1.0, 7.0, 25.00000001, 50.0], small, small)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_operators():
    """The rest doesn't import the subpackage."""
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "gridloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p
