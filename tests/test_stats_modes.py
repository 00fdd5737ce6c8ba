"""Statistics and modes against numpy and tables of Student's t."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import axes as ax
from gridloom.functions import tdist
from gridloom.operators import modes, stats
from gridloom.sources import io, synthetic

T = {1: (12.706, 63.657), 2: (4.303, 9.925), 5: (2.571, 4.032), 10: (2.228, 3.169), 30: (2.042, 2.750), 100: (1.984, 2.626)}


def test_t_tables(spark):
    for nu, (five, one) in T.items():
        assert tdist.two_sided(five, nu) == pytest.approx(0.05, abs=6e-5) and tdist.two_sided(one, nu) == pytest.approx(0.01, abs=1e-5)
        assert tdist.quantile(0.975, nu) == pytest.approx(five, abs=6e-4) and tdist.quantile(0.005, nu) == pytest.approx(-one, abs=6e-4)
    df = spark.createDataFrame([(t, nu) for nu in range(1, 120, 7) for t in (0.0, 0.3, 2.0, 9.0)], "t double, nu long")
    got = df.select("t", "nu", tdist.p_value_whole(F.col("t"), F.col("nu")).alias("a"), tdist.p_value(F.col("t"), F.col("nu").cast("double")).alias("b")).toPandas()
    np.testing.assert_allclose(got.a, got.b, atol=1e-12)
    assert tdist.two_sided(2.3, 7.5) == pytest.approx((tdist.two_sided(2.3, 7) + tdist.two_sided(2.3, 8)) / 2, abs=3e-4)
    assert np.isnan(tdist.two_sided(np.nan, 3)) and np.isnan(tdist.two_sided(1.0, 0))


def two(spark, n=40, hole=True):
    rng = np.random.default_rng(6)
    x, e = rng.normal(size=(2, n)), rng.normal(size=(2, n))
    y = 1.5 * x + 0.3 + e
    if hole:
        x[0, 3], y[1, 5] = np.nan, np.nan
    a = [ax.Axis("k", "index"), ax.time("t", "modeltime365")]
    return io.from_arrays(spark, x, a, [range(2), range(n)], "x"), io.from_arrays(spark, y, a, [range(2), range(n)], "y"), x, y


def test_correlate_and_regress(spark):
    gx, gy, x, y = two(spark)
    c = stats.correlate(gx, gy, ["t"], "r,r2,p,n").get()
    r = stats.regress(gx, gy, ["t"], output="m,b,r2,p,sm,se,n").get()
    for k in range(2):
        ok = ~np.isnan(x[k]) & ~np.isnan(y[k])
        a, b, n = x[k][ok], y[k][ok], ok.sum()
        want = np.corrcoef(a, b)[0, 1]
        assert c.r[k] == pytest.approx(want) and c.n[k] == n and c.p[k] == pytest.approx(float(tdist.two_sided(want * np.sqrt((n - 2) / (1 - want**2)), n - 2)), abs=1e-12)
        m, b0 = np.polyfit(a, b, 1)
        se = np.sqrt(((b - m * a - b0) ** 2).sum() / (n - 2))
        np.testing.assert_allclose([r.m[k], r.b[k], r.se[k], r.sm[k]], [m, b0, se, se / np.sqrt(((a - a.mean()) ** 2).sum())])
        assert r.p[k] == pytest.approx(c.p[k], abs=1e-9)
    flat = gl.Grid(gx.df.withColumn("x", F.lit(1.0)), gx.axes, ("x",))
    assert np.isnan(stats.correlate(flat, gy, ["t"]).get()[["r", "p"]]).all().all()
    with pytest.raises(ValueError):
        stats.correlate(gx, gy, ["t"], "q")


def test_multiple_regress(spark):
    g = synthetic.regression(spark, 20, 4, 5)
    one = lambda c: gl.Grid(g.df.select(*g.keys, c), g.axes, (c,))
    cells = g.get()
    x, y = cells[["X1", "X2", "X3"]].to_numpy(), cells["Y"].to_numpy()
    got = stats.multiple_regress([one("X1"), one("X2"), one("X3")], one("Y"), output="B,r2,p,sb,se").df.first()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    np.testing.assert_allclose(got.beta, beta)
    np.testing.assert_allclose(got.beta, [-0.2, 0.8, -0.6], atol=0.02)
    rest = ((y - x @ beta) ** 2).sum()
    np.testing.assert_allclose(got.sb, np.sqrt(rest / len(y) * np.diag(np.linalg.inv(x.T @ x))))
    assert got.r2 == pytest.approx(1 - rest / ((y - y.mean()) ** 2).sum()) and max(got.p) < 1e-6
    by_lat = stats.multiple_regress([one("X1"), one("X2")], one("Y"), ["time", "lon"]).df
    assert by_lat.count() == 4 and set(by_lat.columns) == {"lat", "lat_weight", "beta", "p"}


def test_regress_values_joins_nothing(spark):
    g = synthetic.regression(spark, 12, 4, 3)
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    one = lambda c: gl.Grid(g.df.select(*g.keys, c), g.axes, (c,))
    h = stats.regress_values(g, ["X1", "X2"], "Y", ["time", "lon"], output="beta,r2,p,sb,covb,se")
    assert joins(h.df) == joins(g.df)
    want = stats.multiple_regress([one("X1"), one("X2")], one("Y"), ["time", "lon"], output="beta,r2,p,sb,covb,se")
    assert h.axes == want.axes
    got, want = (d.df.orderBy(*h.keys).toPandas() for d in (h, want))
    for c in h.values:
        np.testing.assert_allclose(np.stack(got[c].tolist()), np.stack(want[c].tolist()), rtol=1e-7)


def test_multiple_regress2_query_goes_once_through_the_rows(spark, tmp_path):
    """Equal rows count each, rows without a flag are a group; no row meets another."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(f, q, d, 900.0 * q - 5000.0 * d + e) for f in ("A", "R", None) for q, d, e in ((1.0, 0.05, 3.0), (1.0, 0.05, 3.0), (1.0, 0.05, 3.0), (7.0, 0.1, -40.0), (22.0, 0.0, 8.0), (50.0, 0.03, 100.0))]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "l_orderkey long, l_returnflag string, l_quantity double, l_discount double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = entry.queries()["stat_multiple_regress2"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    key = lambda r: str(r[0])
    got, want = sorted(map(tuple, df.collect()), key=key), sorted(con.execute(entry.oracle_sql()["stat_multiple_regress2"]).fetchall(), key=key)
    assert got == want and len(got) == 3


def test_tests(spark):
    gx, gy, x, y = two(spark)
    d = stats.difference(gx, gy, ["t"], output="d,df,p,ci").get()
    p = stats.paired_difference(gx, gy, ["t"], output="d,df,p,ci").get()
    z = stats.isnonzero(gx, ["t"], output="m,df,p,ci").get()
    for k in range(2):
        a, b = x[k][~np.isnan(x[k])], y[k][~np.isnan(y[k])]
        sa, sb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        df = (sa + sb) ** 2 / (sa**2 / (len(a) - 1) + sb**2 / (len(b) - 1))
        np.testing.assert_allclose([d.d[k], d.df[k], d.p[k], d.ci[k]], [a.mean() - b.mean(), df, tdist.two_sided((a.mean() - b.mean()) / np.sqrt(sa + sb), df), tdist.quantile(0.975, df) * np.sqrt(sa + sb)])
        w = (x[k] - y[k])[~np.isnan(x[k]) & ~np.isnan(y[k])]
        den = np.sqrt(w.var(ddof=1) / (len(w) - 1))
        np.testing.assert_allclose([p.d[k], p.df[k], p.p[k]], [w.mean(), len(w) - 1, tdist.two_sided(w.mean() / den, len(w) - 1)])
        np.testing.assert_allclose([z.m[k], z.ci[k]], [a.mean(), tdist.quantile(0.975, len(a) - 1) * np.sqrt(sa)])


@pytest.mark.parametrize("shape_", [(30, 6), (6, 30)])
@pytest.mark.parametrize("limit", [4096, 2])
def test_eof(spark, shape_, limit, monkeypatch):
    monkeypatch.setattr(modes, "EXPLICIT", limit)
    rng = np.random.default_rng(2)
    u, _ = np.linalg.qr(rng.normal(size=(shape_[0], 3)))
    v, _ = np.linalg.qr(rng.normal(size=(shape_[1], 3)))
    m = (u * [9.0, 4.0, 1.5]) @ v.T
    g = io.from_arrays(spark, m, [ax.time("time", "modeltime365"), ax.Axis("x", "xaxis")], [range(shape_[0]), range(shape_[1])])
    got = modes.eof(g, 3)
    eig = got.eig.orderBy("order").toPandas()
    np.testing.assert_allclose(eig.eig, [9, 4, 1.5], rtol=1e-4)
    np.testing.assert_allclose(eig.frac.sum(), 1, rtol=1e-4)
    e, pc = io.to_array(got.eof), io.to_array(got.pc)
    assert (e[:, 0] >= 0).all()
    np.testing.assert_allclose((pc.T * eig.eig.to_numpy()) @ e, m, atol=2e-3)


def test_eof_weights(spark):
    g = synthetic.regression(spark, 12, 4, 3)
    y = gl.Grid(g.df.select(*g.keys, "Y"), g.axes, ("Y",))
    got = modes.eof(y, 12, along=("time",))
    e, pc, eig = got.eof.df, got.pc.df, got.eig
    back = e.join(pc, "order").join(eig, "order").groupBy("time", "lat", "lon").agg(F.sum(F.col("eof") * F.col("eig") * F.col("pc")).alias("r")).join(y.df, ["time", "lat", "lon"])
    assert back.agg(F.max(F.abs(F.col("r") - F.col("Y")))).first()[0] < 1e-6


def test_svd_of_a_grid_with_itself(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(20, 5))
    g = io.from_arrays(spark, m, [ax.time("time", "modeltime365"), ax.Axis("x", "xaxis")], [range(20), range(5)])
    c = modes.svd(g, g, 3)
    np.testing.assert_allclose(io.to_array(c.left), io.to_array(c.right), atol=1e-9)
    want = np.linalg.svd(np.cov(m.T))[1][:3]
    np.testing.assert_allclose(c.eig.orderBy("order").toPandas().eig, want)
    assert modes.svd(g, g, 2, matrix="cor").eig.count() == 2


def test_svd_beyond_the_driver_bound(spark, monkeypatch):
    rng = np.random.default_rng(9)
    shared = rng.normal(size=(20, 2)) * [5, 2]
    one, two = (shared @ rng.normal(size=(2, n)) + 0.05 * rng.normal(size=(20, n)) for n in (6, 4))
    a, b = (io.from_arrays(spark, m, [ax.time("time", "modeltime365"), ax.Axis("x", "xaxis")], [range(20), range(m.shape[1])]) for m in (one, two))
    want = modes.svd(a, b, 2)
    pulled = [(g.df.orderBy(*g.keys).toPandas().to_numpy(float)) for g in (want.left, want.right, want.left_pc, want.right_pc)]
    eig = want.eig.orderBy("order").toPandas().to_numpy(float)
    monkeypatch.setattr(modes, "EXPLICIT", 5)  # fewer than the columns, and than the rows
    got = modes.svd(a, b, 2)
    for g, x in zip((got.left, got.right, got.left_pc, got.right_pc), pulled, strict=True):
        np.testing.assert_allclose(g.df.orderBy(*g.keys).toPandas().to_numpy(float), x, atol=1e-4)
    np.testing.assert_allclose(got.eig.orderBy("order").toPandas().to_numpy(float), eig, rtol=1e-6)
