"""Sources, sinks, metadata, catalogs and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as gl
from gridloom import axes as ax
from gridloom.operators import sets
from gridloom.sources import catalog, cf, io, synthetic
from gridloom.streaming import calmeans


def test_save_and_open(spark, tmp_path):
    g = synthetic.stations(spark)
    io.save(g, f"{tmp_path}/a")
    back = io.open_grid(spark, f"{tmp_path}/a")
    assert back.axes == g.axes and back.values == ("v",) and back.df.count() == 110
    io.save(g, f"{tmp_path}/p", partition_by=["country"])
    plan = io.read_table(spark, f"{tmp_path}/p").where("country = 'NO'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(country" in plan
    renamed = io.open_grid(spark, f"{tmp_path}/a", names={"v": "w", "time": "t"}, kinds={"t": "time"})
    assert renamed.values == ("w",) and renamed.axis("t").kind == "time"
    with pytest.raises(ValueError):
        g.df.write.parquet(f"{tmp_path}/b")
        io.open_grid(spark, f"{tmp_path}/b")
    io.register_reader("mine", lambda s, path: g)
    assert io.open_grid(spark, "x", "mine") is g


def test_packing(spark, tmp_path):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("day"), (300 + F.col("id") / n).alias("var"))
    df = df.withColumn("var", F.when(F.col("day") == 7, float("nan")).otherwise(F.col("var")))
    g = gl.grid(df, [ax.Axis("day", "index")], "var")
    io.save(g, f"{tmp_path}/g", pack=True)
    stored = io.open_grid(spark, f"{tmp_path}/g")
    assert stored.df.schema["var"].dataType.simpleString() == "smallint"
    got, want = io.unpack(stored).get()["var"].to_numpy(), g.get()["var"].to_numpy()
    np.testing.assert_allclose(got, want, atol=2e-5)


def test_conventions(spark):
    df = spark.createDataFrame([(0.5, -10.0, 1, -99), (1.5, 10.0, 2, 7)], "t double, y double, s int, raw int")
    atts = {"t": {"units": "days since 2001-03-01", "calendar": "noleap"}, "y": {"units": "degrees_north", "ancillary_variables": "s"}, "raw": {"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": -99, "long_name": "x"}}
    g = cf.decode(df, atts, ["t", "y"], ["raw"])
    assert [a.kind for a in g.axes] == ["modeltime365", "lat"] and g.axis("y").aux == ("s",) and g.atts == {"long_name": "x"}
    cells = g.get()
    assert np.isnan(cells.raw[0]) and cells.raw[1] == 4.5 and g(month=3, day=2).df.count() == 1
    plain, out = cf.encode(g, "2001-01-01")
    assert out["t"]["calendar"] == "365_day" and plain.orderBy("t").first().t == 59.5 and json.dumps(out)
    again = cf.decode(plain, out, ["t", "y"], ["raw"])
    assert again.axes[0].kind == "modeltime365" and again.get().t.tolist() == cells.t.tolist()
    std = cf.decode(df, {"t": {"units": "hours since 1999-12-31 12:00"}}, ["t"], ["raw"])
    assert str(std.get().t[0]) == "1999-12-31 12:30:00"
    assert cf.fix_name("1 a-b") == "v_1_a_b" and cf.kind_of({"units": "hPa"}) == "pres" and cf.kind_of({"axis": "X"}) == "xaxis"


def test_many_files(spark, tmp_path):
    g = synthetic.stations(spark, 6, 2)
    for i in range(3):
        part = g.df.where((F.dayofmonth("time") - 1).between(2 * i, 2 * i + 1))
        part.coalesce(1).write.parquet(f"{tmp_path}/run_2009010{2 * i + 1}")
    paths = [f"{tmp_path}/run_2009010{d}" for d in (1, 3, 5)]
    assert catalog.open_all(spark, paths, axes=g.axes, values=["v"]).df.count() == 12
    assert catalog.open_all(spark, paths, lambda s, p: gl.grid(s.read.parquet(p), g.axes, "v")).df.count() == 12
    multi = catalog.check_multi(g.df.where("day(time) <> 3"), "time", {"time": "timestamp_ntz", "v": "int", "w": "int"})
    assert multi["gaps"].collect()[0].missing == 1 and multi["missing_dates"].count() == 1
    assert multi["missing"] == ["w"] and multi["mismatched"] == ["v"] and "station" in multi["extra"]
    m = catalog.manifest(spark.read.parquet(*paths), [ax.time("time")], ["v"])
    assert m.count() == 3 and all(len(r.coordinates) == 2 for r in m.collect())
    cover = catalog.coverage(m, "time").first()
    assert len(cover["any"]) == 6 and catalog.domains(m).count() == 1


def test_dates_in_file_names(spark, tmp_path):
    for d in (1, 2, 3):
        frame = spark.range(2).select(F.col("id").alias("x"), F.lit(float(d)).alias("v")).toPandas()
        frame.to_parquet(f"{tmp_path}/obs_2020-01-0{d}.parquet")
    pattern = r"(?P<year>\d{4})-(?P<month>\d\d)-(?P<day>\d\d)"
    g = catalog.open_multi(spark, str(tmp_path), pattern, [ax.time("file_date"), ax.Axis("x", "index")], "v")
    assert g.df.count() == 6 and str(g.get().file_date[0]) == "2020-01-01"
    cut = catalog.open_multi(spark, str(tmp_path), pattern, [ax.time("file_date"), ax.Axis("x", "index")], "v", between=("2020-01-02", "2020-01-03"))
    assert cut.df.count() == 4 and len(cut.df.inputFiles()) == 2


def test_find_best(spark):
    g = synthetic.surface(spark, 3, 4)
    c = catalog.Catalog((({"res": 1, "years": 10}, g), ({"res": 2, "years": 30}, g.rename("b")), ({"res": 2, "years": 20}, g.rename("c"))))
    assert c.have(res=1) and not c.have(res=5) and len(c.find(years=lambda y: y > 15)) == 2
    assert c.find_best(maximize=[lambda p: p["res"]], minimize=[lambda p: p["years"]]).value == "c"


def test_wide_and_gaps(spark):
    g = synthetic.surface(spark, 3, 4)
    assert io.wide(gl.Dataset.of([g, g.rename("b")])).columns == ["lat", "lon", "Temp", "b"]
    a, b = spark.range(5).select(F.col("id").alias("x")), spark.range(3, 8).select(F.col("id").alias("x"))
    assert [sets.axis_union(a, b, "x").count(), sets.axis_intersection(a, b, "x").count(), sets.axis_difference(a, b, "x").count()] == [8, 2, 3]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    calmeans.run_available(calmeans.climatology(stream(), "ts", ["value"], ["event_type"]), "clim_of_stream", "complete", f"{tmp_path}/c")
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), "event_type").agg(F.avg("value").alias("want"))
    both = spark.table("clim_of_stream").join(want, ["month", "day", "event_type"])
    assert both.count() == want.count() and both.where("abs(value - want) > 1e-9").count() == 0
    calmeans.run_available(calmeans.windowed(stream(), "ts", ["value"], how="nanmax", width="2 days", slide="1 day"), "max_of_stream", "append", f"{tmp_path}/m")
    assert spark.table("max_of_stream").count() > 20


def test_netcdf_round_trip(spark, tmp_path):
    from gridloom.sources import netcdf

    g = synthetic.atmosphere(spark, 3, 2, 3, 4)
    temp = gl.Grid(g.df.select(*g.keys, "Temp"), g.axes, ("Temp",), {"units": "K"})
    netcdf.write(temp, f"{tmp_path}/t.nc")
    back = io.open_grid(spark, f"{tmp_path}/t.nc", "netcdf")
    assert [a.kind for a in back.Temp.axes] == ["modeltime365", "pres", "lat", "lon"] and back.Temp.atts == {"units": "K"}
    np.testing.assert_allclose(io.to_array(back.Temp), io.to_array(temp))
    io.save(temp, f"{tmp_path}/p.nc", "netcdf", pack=False)
    netcdf.write(temp, f"{tmp_path}/q.nc", pack=True)
    np.testing.assert_allclose(io.to_array(netcdf.read(spark, f"{tmp_path}/q.nc").Temp), io.to_array(temp), atol=2e-3)
    many = netcdf.read(spark, [f"{tmp_path}/t.nc", f"{tmp_path}/p.nc"])
    assert many.Temp.df.count() == 2 * temp.df.count()
    with pytest.raises(ValueError):
        netcdf.write(temp, f"{tmp_path}/x.nc", most=5)


def test_netcdf_records():
    """Two record variables, interleaved and padded, as the format lays them."""
    import struct

    from gridloom.sources import netcdf

    text = lambda s: struct.pack(">I", len(s)) + s.encode() + bytes(-len(s) % 4)
    none = struct.pack(">II", 0, 0)
    dims = struct.pack(">II", 10, 2) + text("t") + struct.pack(">I", 0) + text("x") + struct.pack(">I", 3)
    head = lambda a, b: b"CDF\x01" + struct.pack(">I", 2) + dims + none + struct.pack(">II", 11, 2) + text("s") + struct.pack(">III", 2, 0, 1) + none + struct.pack(">III", 3, 8, a) + text("t") + struct.pack(">II", 1, 0) + none + struct.pack(">III", 6, 8, b)
    a = len(head(0, 0))
    buf = head(a, a + 8) + b"".join(np.array([i, i + 1, i + 2], ">i2").tobytes() + bytes(2) + np.array([i * 0.5], ">f8").tobytes() for i in (10, 20))
    h = netcdf.header(buf)
    assert h.record_size == 16 and h.dims == {"t": 2, "x": 3}
    assert netcdf.values(buf, h, "s").tolist() == [[10, 11, 12], [20, 21, 22]] and netcdf.values(buf, h, "t").tolist() == [5.0, 10.0]


def grib_message(values, lat, lon, level, day, bits=12, holes=(), gaussian=0):
    """A message packed by plain arithmetic."""
    n24, sign = (lambda x: int(x).to_bytes(3, "big")), lambda x, n: (abs(int(x)) | ((x < 0) << (8 * n - 1))).to_bytes(n, "big")
    flat = values.ravel()
    keep = np.array([i not in holes for i in range(flat.size)])
    low = np.floor(flat[keep].min())
    e = int(np.ceil(np.log2(max((flat[keep].max() - low) / (2**bits - 1), 1e-9))))
    x = np.round((flat[keep] - low) / 2.0**e).astype(int)
    stream = "".join(format(k, f"0{bits}b") for k in x)
    unused = -len(stream) % 16
    stream += "0" * unused
    packed = int(stream, 2).to_bytes(len(stream) // 8, "big")
    power = 64
    m = abs(low)
    while m >= 1:
        m, power = m / 16, power + 1
    ref = bytes([power | (0x80 if low < 0 else 0)]) + int(m * 2**24).to_bytes(3, "big")
    data = sign(e, 2) + ref + bytes([bits]) + packed
    data = n24(len(data) + 4) + bytes([unused]) + data
    bitmap = b""
    if holes:
        raw = np.packbits(keep).tobytes()
        bitmap = n24(6 + len(raw)) + bytes([-flat.size % 8, 0, 0]) + raw
    grid = bytes([0, 255, 4 if gaussian else 0]) + len(lon).to_bytes(2, "big") + len(lat).to_bytes(2, "big") + sign(round(lat[0] * 1000), 3) + sign(round(lon[0] * 1000), 3) + bytes([128]) + sign(round(lat[-1] * 1000), 3) + sign(round(lon[-1] * 1000), 3) + bytes(2) + gaussian.to_bytes(2, "big") + bytes([0]) + bytes(4)
    grid = n24(len(grid) + 3) + grid
    product = bytes([3, 7, 1, 255, 0x80 | (0x40 if holes else 0), 11, 100]) + level.to_bytes(2, "big") + bytes([1, 3, day, 6, 0, 1, 6, 0, 0, 0, 0, 0, 21, 0]) + bytes(2)
    product = n24(28) + product
    body = product + grid + bitmap + data + b"7777"
    return b"GRIB" + n24(len(body) + 8) + b"\x01" + body


def test_grib(spark, tmp_path):
    from gridloom.sources import grib

    rng = np.random.default_rng(3)
    lat, lon = np.array([60.0, 0.0, -60.0]), np.array([0.0, 90.0, 180.0, 270.0])
    fields = {(level, day): 250 + 30 * rng.random((3, 4)) for level in (500, 850) for day in (1, 2)}
    (tmp_path / "a.grib").write_bytes(b"junk" + b"".join(grib_message(v, lat, lon, *k) for k, v in fields.items()))
    d = grib.read(spark, f"{tmp_path}/a.grib", {11: "T"})
    g = d.T
    assert g.axis("level").kind == "pres" and g.df.count() == 48 and str(g.get().time.min()) == "2001-03-01 12:00:00"
    got = {(int(r.level), r.time.day, r.lat, r.lon): r.T for r in g.df.collect()}
    for (level, day), v in fields.items():
        for i, j in np.ndindex(v.shape):
            assert got[level, day, lat[i], lon[j]] == pytest.approx(v[i, j], abs=0.02)
    holed = grib_message(fields[500, 1], lat, lon, 500, 1, holes=(2, 5))
    _, _, _, v = grib.field(holed)
    assert np.isnan(v.ravel()[[2, 5]]).all() and np.isnan(v).sum() == 2
    negative = fields[500, 1] - 300
    np.testing.assert_allclose(grib.field(grib_message(negative, lat, lon, 500, 1))[3], negative, atol=0.02)
    gauss = ax.gausslat(spark, 4, -1).toPandas()["lat"].to_numpy()
    _, la, _, _ = grib.field(grib_message(np.zeros((4, 4)) + 1, gauss, lon, 500, 1, gaussian=2))
    np.testing.assert_allclose(la, gauss)
    with pytest.raises(ValueError):
        list(grib.messages(holed[:-2]))
