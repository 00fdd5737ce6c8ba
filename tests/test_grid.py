"""Selection, alignment, shapes, sets, reductions against numpy."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import axes as ax
from gridloom.functions import npmath
from gridloom.operators import align, reduce, select, sets, shape
from gridloom.sources import io, synthetic


def dense(spark, shape_, seed=0, names="xyz", kinds=("xaxis", "yaxis", "zaxis")):
    rng = np.random.default_rng(seed)
    coords = [np.sort(rng.normal(size=n)) for n in shape_]
    v = rng.normal(size=shape_)
    return io.from_arrays(spark, v, [ax.Axis(n, k) for n, k, _ in zip(names, kinds, shape_)], coords), v, coords


@pytest.mark.parametrize("n", [1, 2, 10])
@pytest.mark.parametrize("index", [0, -1, (0, 1), (1, None), (0, None, 2), (-2, None), [0, -1], [0]])
def test_positions(spark, n, index):
    g, v, _ = dense(spark, (n, 3), n)
    if isinstance(index, int):
        want = v[[index % n]]
    elif isinstance(index, tuple):
        want = v[slice(*index)]
    else:
        want = v[sorted({i % n for i in index})]
    got = io.to_array(g(i_x=index)) if want.size else np.zeros(want.shape)
    assert g(i_x=index).df.count() == want.size
    np.testing.assert_array_equal(got.reshape(want.shape), want)


def test_selection_kinds(spark):
    g = synthetic.stations(spark)
    assert g(station="S003").df.count() == 10 and g(station="none").df.count() == 0
    assert {r.station for r in g(country="NO").df.collect()} == {"S001", "S004", "S007", "S010"}
    assert g(l_elevation=[0, 300]).df.count() == 20 and g(n_elevation=(0, 900)).df.count() == 10
    assert g(time="2009-01-04").df.count() == 11 and g(l_day=[1, 2], s_station="S001").axes[0].name == "time"
    assert g(time=("5 Jan 2009", "2009-01-02")).df.count() == 44
    with pytest.raises(KeyError):
        g(nothing=1)
    with pytest.raises(ValueError):
        g(s_time=("2009-01-01", "2009-01-03"))
    t = synthetic.surface(spark)
    assert t(lat=31.7).df.select("lat").distinct().collect()[0][0] == 30.0
    np.testing.assert_allclose(t(m_lat=(-30, 30), si_lon=0).scalar(), (lambda la: np.average(260 + 40 * np.exp(-((la / 45) ** 2)), weights=np.cos(np.radians(la))))(np.arange(-30, 31, 6.0)))
    assert [a.name for a in gl.Dataset.of(t)(lat=0, nothing=3).Temp.axes] == ["lat", "lon"]


def test_taken_and_order(spark):
    g, v, _ = dense(spark, (5, 2), 3)
    got = select.taken(g, "x", [4, 4, 0, -2], "place")
    np.testing.assert_array_equal(io.to_array(gl.Grid(got.df.select("place", "y", "v"), (ax.Axis("place", "index"), got.axes[1]), ("v",))), v[[4, 4, 0, 3]])
    assert select.monotonic(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "i int, x double"), "x", "i") == 1
    assert select.monotonic(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0)], "i int, x double"), "x", "i") == 0


def test_subset_and_mismatched_axes(spark):
    g, v, _ = dense(spark, (6, 3), 5)
    np.testing.assert_allclose(io.to_array(g + g(i_x=(1, 4))), 2 * v[1:4])
    with pytest.raises(ValueError):
        g(i_x=(0, 4)) + g(i_x=(2, 6))
    moved = shape.replace_axis(g, "x", g.axis("x"), relabel=F.col("x") * (1 + 1e-7))
    np.testing.assert_allclose(io.to_array(g - moved), 0 * v, atol=1e-15)
    with pytest.raises(ValueError):
        g * shape.replace_axis(g, "x", g.axis("x"), relabel=F.col("x") + 0.01)


def test_outer_product_and_scalars(spark):
    (a, x, _), (b, y, _) = dense(spark, (4,), 1, "x"), dense(spark, (3,), 2, "y", ("yaxis",))
    np.testing.assert_allclose(io.to_array(a * b), np.outer(x, y))
    np.testing.assert_allclose(io.to_array(1 - a), 1 - x)
    np.testing.assert_allclose(io.to_array(2.0**a % 3), 2.0**x % 3)
    np.testing.assert_allclose(io.to_array(abs(-a)), abs(x))
    assert a.sum().axes == () and a.sum().scalar() == pytest.approx(x.sum())


EDGE = [0.0, 1.0, -1.0, 2.5, -2.5, np.nan, np.inf, -np.inf, 1e300]


@pytest.mark.parametrize("name", ["exp", "sqrt", "log", "log10", "sin", "cosh", "tanh", "arcsin", "arccosh", "arctanh", "arctan", "sign", "abs", "neg", "nan_to_num", "trunc", "sind", "arcsind"])
def test_unary_like_numpy(spark, name):
    degrees = {"sind": lambda v: np.sin(np.radians(v)), "arcsind": lambda v: np.degrees(np.arcsin(v)), "neg": np.negative}
    f = degrees.get(name) or getattr(np, name)
    some = [x for x in EDGE if not (name in ("trunc", "sin", "sind") and abs(x) >= 1e300)]
    with np.errstate(all="ignore"):
        want = f(np.array(some))
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(some)], "i int, x double").orderBy("i").select(npmath.UNARY[name]("x")).collect()]
    np.testing.assert_allclose(np.array(got, float), want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("name,f", [("div", np.divide), ("mod", np.mod), ("pow", np.power), ("minimum", np.minimum), ("maximum", np.maximum), ("arctan2", np.arctan2), ("lt", np.less), ("ge", np.greater_equal), ("eq", np.equal), ("ne", np.not_equal)])
def test_binary_like_numpy(spark, name, f):
    some = [x for x in EDGE if not (name == "mod" and np.isinf(x)) and abs(x) != 1e300]
    pairs = list(itertools.product(some, some))
    a, b = np.array(pairs).T
    with np.errstate(all="ignore"):
        want = f(a, b)
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").orderBy("i").select(npmath.BINARY[name]("a", "b")).collect()]
    np.testing.assert_allclose(np.array(got, float), want.astype(float), rtol=1e-12, atol=1e-12)


def test_weighted_and_nan_reductions(spark):
    g = synthetic.regression(spark, 2, 8, 6)
    one = gl.Grid(g.df.select(*g.keys, F.when(F.col("lon") == 60, float("nan")).otherwise(F.col("Y")).alias("Y")), g.axes, ("Y",))
    cells = one.get()
    for name, f in {"nanmean": lambda c: (c.Y * c.lat_weight).sum() / c.lat_weight[c.Y.notna()].sum() if c.Y.notna().any() else np.nan, "mean": lambda c: np.nan if c.Y.isna().any() else np.average(c.Y, weights=c.lat_weight), "nansum": lambda c: (c.Y * c.lat_weight).sum(), "nanmin": lambda c: c.Y.min()}.items():
        want = cells.groupby("lon")[["Y", "lat_weight"]].apply(f)
        got = getattr(one, name)("time", "lat").get().set_index("lon")["Y"]
        np.testing.assert_allclose(got, want, err_msg=name)
    lone = gl.grid(spark.createDataFrame([(0, 1.0), (1, float("nan"))], "x int, v double"), [ax.Axis("x", "index")], "v")
    assert np.isnan(lone(x=0).variance("x").scalar()) and np.isnan(lone(x=1).nanmean("x").scalar()) and lone(x=1).nansum("x").scalar() == 0
    assert lone.argmax("x").scalar() == 1 and lone.argmin("x").scalar() == 1
    with pytest.raises(ValueError):
        lone(x=7).mean("x")


@pytest.mark.parametrize("shape_", [(1,), (3,), (2, 3), (20, 2)])
def test_concat(spark, shape_):
    g, v, _ = dense(spark, shape_, 9)
    g = gl.Grid(g.df, g.axes, g.values, {"a": 1, "b": 2})
    for i, n in enumerate(shape_):
        for cut in {0, 1, n // 3, n - 1, n}:
            a, b = g(**{f"i_{'xyz'[i]}": (0, cut)}), g(**{f"i_{'xyz'[i]}": (cut, n)})
            b = gl.Grid(b.df, b.axes, b.values, {"a": 1, "b": 3})
            whole = sets.concat(a, b)
            assert whole.atts == {"a": 1}
            np.testing.assert_array_equal(io.to_array(whole), v)
    assert io.to_array(sets.ensemble(g, g)).shape == (2, *shape_)
    with pytest.raises(ValueError):
        sets.concat(g, shape.replace_axis(g, "x", g.axis("x"), relabel=F.col("x") + 1), which="y") if len(shape_) > 1 else sets.stacked([g, g.rename("w")], ax.Axis("n", "index"))


def test_datasets(spark):
    g, v, _ = dense(spark, (3,), 2)
    d = gl.Dataset.of([g, g, g.rename("w")])
    assert list(d.grids) == ["v", "v_2", "w"] and "w" in d and "v" not in d - "v" and len(d + g.rename("z")) == 4
    assert list(d.rename(w="u").grids) == ["v", "v_2", "u"] and d.has_axis("xaxis")
    np.testing.assert_allclose([m.scalar() for m in d.mean("x")], [v.mean()] * 3)
    np.testing.assert_allclose(d.replaced(w=g * 2).w.max("x").scalar(), 2 * v.max())


def test_shapes(spark):
    g, v, _ = dense(spark, (2, 3), 4)
    flat = shape.flatten(g, "x", "y").get()
    np.testing.assert_array_equal(flat["v"], v.ravel())
    assert [a.name for a in g.transpose("y").axes] == ["y", "x"] and io.to_array(g.transpose("y")).shape == (3, 2)
    assert g.rename_axes(x="p").df.columns == ["p", "y", "v"]
    longer = spark.range(3).select(F.col("id").cast("double").alias("y2"))
    assert sorted(r.y2 for r in shape.replace_axis(g, "y", ax.Axis("y2", "yaxis"), longer).df.select("y2").distinct().collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        shape.replace_axis(g, "x", ax.Axis("y2", "xaxis"), longer)
    assert shape.extend(g, ax.Axis("y2", "zaxis"), longer).df.count() == 18
    assert g.as_type("int").df.schema["v"].dataType.simpleString() == "int"
    assert np.isnan(g.unfill(float(v[0, 0])).get()["v"]).sum() == 1
    assert g.squeeze().axes == g.axes and g(si_x=0).axes == (g.axes[1],)
    assert reduce.AGGREGATES["max"] and align.binary(g, 2.0, npmath.BINARY["add"]).df.count() == 6
    meta = {f.name: f.metadata for f in g.with_metadata().schema}
    assert meta["x"]["kind"] == "xaxis" and meta["v"]["variable"] == "v"


def test_axis_lookup_and_formats(spark):
    g = synthetic.atmosphere(spark, 2, 2, 3, 4)
    assert g.axis("T").name if g.has_axis("T") else g.axis("taxis").name == "time"
    assert g.axis("PRES").order == -1 and g.axis(2).kind == "lat" and g.axis("zaxis").name == "pres" and not g.has_axis("station")
    df = spark.createDataFrame([(270.0,), (-20.346,), (5.0,)], "x double")
    assert [r[0] for r in df.select(ax.formatted(ax.lon(), F.col("x"), "%.4gE")).collect()] == ["90W", "20.35W", "5E"]
    assert [r[0] for r in df.select(ax.formatted(ax.lat(), F.col("x") / 10)).collect()] == ["27 N", "2 S", "0.5 N"]
    w = ax.gausslat(spark, 32).toPandas()
    assert w["lat_weight"].sum() == pytest.approx(2) and (w["lat"].diff().dropna() > 0).all()
    assert ax.spectral(spark, 3).count() == 10 and ax.regularlon(spark, 4, repeat=True).count() == 5


def test_asof(spark):
    left = spark.createDataFrame([(1, "a"), (5, "a"), (9, "b"), (0, "b")], "t int, k string")
    right = spark.createDataFrame([(1, "a", 10), (4, "a", 40), (8, "b", 80), (20, "b", 0)], "t int, k string, x int")
    got = {(r.t, r.k): r.x for r in align.asof(left, right, "t", ["x"], ["k"]).collect()}
    assert got == {(1, "a"): 10, (5, "a"): 40, (9, "b"): 80, (0, "b"): None}


def test_pandas_in_and_out(spark):
    g = io.from_pandas(spark, pd.DataFrame({"x": [0, 1], "v": [1.0, 2.0]}), [ax.Axis("x", "index")], "v")
    assert io.to_arrow(g).num_rows == 2 and g.load().get()["v"].tolist() == [1.0, 2.0]


@pytest.mark.parametrize("snap", [200_000, 0])
def test_tolerance_holds_above_the_driver_bound(spark, monkeypatch, snap):
    monkeypatch.setattr(align, "SNAP", snap)
    near = [i * 0.1 * (1 + (-1) ** i * 1e-7) for i in range(-150, 150)]

    def of(xs):
        return gl.grid(spark.createDataFrame([(float(x), float(k)) for k, x in enumerate(xs)], "x double, v double"), [ax.Axis("x", "xaxis")], "v")

    xs = [i * 0.1 for i in range(-150, 150)]
    got = align.binary(of(xs), of(near), lambda a, b: a * b).df.orderBy("x").collect()
    assert [(r.x, r.v) for r in got] == [(x, float(k * k)) for k, x in enumerate(xs)]
    loose = align.binary(of(xs), of([*near[:100], 3.05, 900.0]), lambda a, b: a + b, check=False).df.collect()
    assert sorted(r.x for r in loose) == xs[:100]
    with pytest.raises(ValueError):
        align.binary(of(xs), of([*near[:100], 3.05, 900.0]), lambda a, b: a + b)
