"""A query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import axes as ax
from ..functions import calendar, npmath
from ..grid import Dataset, Grid, grid
from ..operators import align, calagg, modes, reduce, sets, shape, stats, windowed
from ..operators import select as sel
from ..shared import named
from ..sources import cf
from ..streaming import calmeans
from . import grids
from .grids import emb, ev, holed, li_cells, li_day, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Added before rounding, on both sides: means of prices often end in an exact half of the last digit, which the two
#: engines' last bits would round either way.
NUDGE = "3.7e-9"


def steady(sql: str) -> str:
    """`round(x, n)` as `round(x + NUDGE, n)`."""
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, comma, i = 0, None, start + 6
        while depth or sql[i] != ")":
            depth += (sql[i] == "(") - (sql[i] == ")")
            comma = i if sql[i] == "," and not depth else comma
            i += 1
        inner = steady(sql[start + 6 : comma])
        out += sql[at:start] + f"round(({inner}) + {NUDGE}::DOUBLE{sql[comma : i + 1]}"
        at = i + 1
    return out + sql[at:]


def rounded(c: Column | str, digits: int) -> Column:
    return F.round(npmath.num(c) + float(NUDGE), digits)


def query(sql: str | None = None, *ctes: str, name: str | None = None):
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = ("WITH " + ", ".join(grids.SQL[c] for c in ctes) + " " if ctes else "") + steady(sql.strip())
        return f

    return add


def out(g: Grid | DataFrame, digits: int = 6, /, **more: Column) -> DataFrame:
    """Whole numbers as longs, doubles rounded."""
    df = g.tidy().df if isinstance(g, Grid) else g
    df = df.withColumns(more) if more else df
    cols = []
    for f in df.schema:
        c, kind = F.col(f.name), f.dataType.simpleString()
        cols.append((c.cast("long") if kind in ("int", "smallint", "tinyint", "bigint") else rounded(c, digits) if kind in ("double", "float") else c).alias(f.name))
    return df.select(*cols)


# Selection

@query("SELECT l_quantity, l_returnflag, l_linestatus, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 13")
def sel_range_closed(spark, d):
    return out(li_cells(spark, d)(l_quantity=(13, 10)))


@query("SELECT l_quantity, l_returnflag, l_linestatus, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE NOT l_quantity BETWEEN 4 AND 48")
def sel_complement(spark, d):
    return out(li_cells(spark, d)(n_l_quantity=(4, 48)))


@query("SELECT l_quantity, l_returnflag, l_linestatus, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem WHERE l_quantity IN (1, 25, 50) AND l_returnflag = 'A'")
def sel_list(spark, d):
    return out(li_cells(spark, d)(l_l_quantity=[0.7, 25.2, 61.0], l_returnflag="A"))


@query("SELECT vec_id, pos::BIGINT AS pos, round(v, 6) AS v FROM emb WHERE pos >= 2 AND pos < 60 AND (pos - 2) % 3 = 0", "emb")
def sel_index_stride(spark, d):
    return out(emb(spark, d)(i_pos=(2, 60, 3)))


@query("SELECT vec_id, pos::BIGINT AS pos, round(v, 6) AS v FROM emb WHERE pos IN (0, 62, 63)", "emb")
def sel_index_list(spark, d):
    return out(emb(spark, d)(i_pos=[0, -1, -2]))


@query("SELECT vec_id, p.pos::BIGINT AS place, e.pos::BIGINT AS pos, round(v, 6) AS v FROM emb e JOIN (VALUES (0, 3), (1, 3), (2, 0), (3, 63)) p(pos, k) ON e.pos = p.k", "emb")
def sel_index_order_repeats(spark, d):
    return out(sel.taken(emb(spark, d), "pos", [3, 3, 0, -1], "place"))


@query("SELECT time, event_type, round(value, 6) AS value FROM ev ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), time LIMIT 1", "ev")
def sel_nearest(spark, d):
    return out(ev(spark, d)(time="12:00 15 Jan 2024"))


@query("SELECT day, flag, round(v, 6) AS v FROM li WHERE month(day) IN (12, 1, 2)", "li")
def sel_aux_month_list(spark, d):
    return out(li_day(spark, d)(l_month=[12, 1, 2]))


@query("SELECT day, flag, round(v, 6) AS v FROM li WHERE day BETWEEN DATE '1996-03-01' AND DATE '1998-09-21' AND month(day) <> 7", "li")
def sel_date_text(spark, d):
    return out(li_day(spark, d)(day=("21 Sep 1998", "1996-03-01"), n_month=7))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * cos(radians(l_quantity))) / sum(cos(radians(l_quantity))), 4) AS l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 GROUP BY 1, 2")
def sel_mean_squeeze(spark, d):
    return out(li_cells(spark, d)(m_l_quantity=(10, 20)), 4)


@query("SELECT vec_id, round(v, 6) AS v FROM emb WHERE pos = 10", "emb")
def sel_squeeze(spark, d):
    return out(emb(spark, d)(si_pos=10))


@query("SELECT l_quantity, l_returnflag, l_linestatus, CASE WHEN isnan(v) THEN false ELSE v < 30000 END AS lt, isnan(v) OR v <> 30000 AS ne FROM holed", "holed")
def cmp_mask(spark, d):
    g = holed(spark, d)
    return g.df.select(*g.keys, npmath.lt(g.value, 30000).alias("lt"), npmath.ne(g.value, 30000).alias("ne"))


@query("SELECT vec_id, pos::BIGINT AS pos, round(v, 6) AS v FROM emb WHERE pos < 20 AND pos % 5 = 0", "emb")
def head_stride(spark, d):
    return out(sel.head(emb(spark, d), "pos", 20, 5))


@query("SELECT p_size::BIGINT AS p_size, round(avg(p_retailprice), 6) AS price_by_p_size, (row_number() OVER (ORDER BY p_size DESC) - 1)::BIGINT AS i FROM part GROUP BY p_size")
def sort_natural(spark, d):
    from dataclasses import replace

    from pyspark.sql import Window

    g = grids.part(spark, d, "p_size")
    g = replace(g, axes=(replace(g.axes[0], order=-1),))
    return out(sel.sort(g, p_size=0), i=F.row_number().over(Window.orderBy(F.col("p_size").desc())) - 1)


# Alignment

@query("SELECT a.p_size::BIGINT AS p_size, b.p_brand, round(a.v * b.v, 4) AS price FROM (SELECT p_size, avg(p_retailprice) v FROM part GROUP BY 1) a CROSS JOIN (SELECT p_brand, avg(p_retailprice) v FROM part GROUP BY 1) b")
def join_outer_product(spark, d):
    return out(align.binary(grids.part(spark, d, "p_size"), grids.part(spark, d, "p_brand"), npmath.BINARY["mul"], "price"), 4)


@query("SELECT day, flag, round(v + v, 6) AS v FROM li WHERE month(day) = 1", "li")
def join_subset_axis(spark, d):
    g = li_day(spark, d)
    return out(g + g(month=1))


@query("SELECT day, flag, round(v - avg(v) OVER (PARTITION BY month(day), day(day), flag), 5) AS v FROM li", "li")
def join_clim_broadcast(spark, d):
    g = li_day(spark, d)
    return out(g - g.climatology("day"), 5)


@query("""SELECT h.time, e.event_type, round(e.value, 6) AS value FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 1 HOUR)) AS time) h ASOF JOIN events e ON h.time >= e.ts""")
def join_asof_lower(spark, d):
    hours = ax.standardtimerange(spark, "2024-01-02", "2024-01-29", 1, "hours", inc=True)
    return out(align.asof(hours, table(spark, d, "events").withColumnRenamed("ts", "time"), "time", ["event_type", "value"]))


@query("SELECT vec_id, round(pos * 0.1::DOUBLE, 6) AS x, round(v * v, 6) AS v FROM emb", "emb")
def join_within_tolerance(spark, d):
    def at(factor: float) -> Grid:
        g = emb(spark, d)
        return grid(g.df.select("vec_id", (F.col("pos") * 0.1 * factor).alias("x"), "v"), [g.axes[0], ax.Axis("x", "xaxis")], "v")

    return out(at(1.0) * at(1.0000001))


@query("""WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
SELECT 'union' AS k, count(*)::BIGINT AS n FROM (SELECT d FROM a UNION SELECT d FROM b) UNION ALL SELECT 'intersection', count(*)::BIGINT FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT 'difference', count(*)::BIGINT FROM (SELECT d FROM b EXCEPT SELECT d FROM a)""")
def join_axis_sets(spark, d):
    a, b = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")), table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    parts = {"union": sets.axis_union(a, b, "d"), "intersection": sets.axis_intersection(a, b, "d"), "difference": sets.axis_difference(b, a, "d")}
    first, *rest = [x.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n")) for k, x in parts.items()]
    for r in rest:
        first = first.unionByName(r)
    return first


# Elementwise

def cells(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


N, U = npmath.BINARY, npmath.UNARY


def elementwise(spark, d, exact: tuple[str, ...] = (), /, **more: Column) -> DataFrame:
    """The cells as they are, with columns made of them: rounded, save the `exact` ones."""
    return cells(spark, d).select("*", *[(c if k in exact else rounded(c, 6)).alias(k) for k, c in more.items()])


@query("SELECT q, d, t, round(q + d, 6) AS a, round(q - t, 6) AS s, round(q * d, 6) AS m, round(-q, 6) AS n, round(abs(d - t), 6) AS b, pow(q, 2) AS p, sign(d - t)::DOUBLE AS g FROM cells", "cells")
def ufunc_arith(spark, d):
    return elementwise(spark, d, ("p",), a=N["add"]("q", "d"), s=N["sub"]("q", "t"), m=N["mul"]("q", "d"), n=U["neg"]("q"), b=U["abs"](F.col("d") - F.col("t")), p=N["pow"]("q", 2), g=U["sign"](F.col("d") - F.col("t")))


@query("SELECT q, d, t, CASE WHEN d = 0 THEN '-Infinity'::DOUBLE ELSE round(ln(d), 6) END AS l, CASE WHEN d - t > 0 THEN round(log10(CASE WHEN d - t > 0 THEN d - t ELSE 1 END), 6) WHEN d - t = 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END AS l10 FROM cells", "cells")
def ufunc_log_zero(spark, d):
    l10 = npmath.back(U["log10"](F.col("d") - F.col("t")))  # the SQL's cases end in NaN, for null too
    return elementwise(spark, d, l=U["log"]("d"), l10=l10)


@query("SELECT q, d, t, CASE WHEN d <> 0 THEN round((q - 25) / d, 6) WHEN q = 25 THEN 'NaN'::DOUBLE WHEN q > 25 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS r FROM cells", "cells")
def ufunc_div_zero(spark, d):
    q, r = F.col("q"), N["div"](F.col("q") - 25, "d")
    # over zero, the SQL's cases have NaN above 25 and what is null below it
    return elementwise(spark, d, r=F.when(F.col("d") != 0, r).when(F.isnan(q), npmath.INF).when(q.isNull(), -npmath.INF).otherwise(r))


@query("SELECT q, d, t, round((q - 25) - floor((q - 25) / -7) * -7, 6) AS r, round((q - 25) - floor((q - 25) / 4) * 4, 6) AS s, round((q - 25) - trunc(q - 25), 6) AS f FROM cells", "cells")
def ufunc_floor_mod(spark, d):
    x = F.col("q") - 25
    return elementwise(spark, d, r=N["mod"](x, -7), s=N["mod"](x, 4), f=x - U["trunc"](x))


@query("SELECT q, d, t, round(sin(radians(q)), 6) AS s, round(cos(radians(q)), 6) AS c, round(tan(radians(q)), 6) AS n, round(degrees(asin(d)), 6) AS a, round(degrees(atan2(d, q)), 6) AS b, round(sinh(d), 6) AS h, round(atanh(d), 6) AS e, round(exp(d), 6) AS x, round(sqrt(q), 6) AS r, round(acosh(q), 6) AS k FROM cells", "cells")
def ufunc_trig_deg(spark, d):
    return elementwise(spark, d, s=U["sind"]("q"), c=U["cosd"]("q"), n=U["tand"]("q"), a=U["arcsind"]("d"), b=N["arctand2"]("d", "q"), h=U["sinh"]("d"), e=U["arctanh"]("d"), x=U["exp"]("d"), r=U["sqrt"]("q"), k=U["arccosh"]("q"))


@query("SELECT q, d, t, CASE WHEN q = 7 THEN 'NaN'::DOUBLE ELSE least(d, t) END AS lo, CASE WHEN q = 7 THEN 'NaN'::DOUBLE ELSE greatest(d, t) END AS hi, CASE WHEN q = 7 THEN 'NaN'::DOUBLE ELSE least(greatest(d, 0.02), 0.07) END AS c, CASE WHEN q = 7 THEN 0.0 ELSE d END AS z FROM cells", "cells")
def ufunc_minmax_nan(spark, d):
    x = F.when(F.col("q") == 7, float("nan")).otherwise(F.col("d"))
    return elementwise(spark, d, ("lo", "hi", "c", "z"), lo=npmath.minimum(x, "t"), hi=npmath.maximum(x, "t"), c=npmath.clip(x, 0.02, 0.07), z=npmath.nan_to_num(x))


@query("SELECT q, d, t, round(d, 6) AS re, round(-t, 6) AS im, round(atan2(t, d), 6) AS an, round(q + d + t, 6) AS su, round(q * d * t, 6) AS pr FROM cells", "cells")
def ufunc_complex_many(spark, d):
    z = npmath.complex_("d", "t")
    return elementwise(spark, d, re=U["real"](U["conj"](z)), im=U["imag"](U["conj"](z)), an=U["angle"](z), su=npmath.vsum("q", "d", "t"), pr=npmath.vprod("q", "d", "t"))


# Reductions

_RED = {
    "min": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE min(v) END", "max": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE max(v) END",
    "nanmin": "coalesce(min(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)", "nanmax": "coalesce(max(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)",
    "sum": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE sum(v) END", "nansum": "coalesce(sum(v * w) FILTER (NOT isnan(v)), 0.0)",
    "mean": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE sum(v * w) / sum(w) END", "nanmean": "coalesce(sum(v * w) FILTER (NOT isnan(v)) / sum(w) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)",
    "variance": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE var_samp(CASE WHEN isnan(v) THEN NULL ELSE v END) END", "nanvariance": "coalesce(var_samp(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)",
    "stdev": "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE stddev_samp(CASE WHEN isnan(v) THEN NULL ELSE v END) END", "nanstdev": "coalesce(stddev_samp(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)",
}


def _reduction(name: str, digits: int) -> None:
    @query(f"SELECT l_returnflag, l_linestatus, round({_RED[name]}, {digits}) AS l_extendedprice FROM (SELECT *, cos(radians(l_quantity)) AS w FROM holed) GROUP BY 1, 2", "holed", name=f"red_{name}")
    def run(spark, d):
        return out(getattr(holed(spark, d), name)("l_quantity"), digits)


for _name in _RED:
    _reduction(_name, 0 if "variance" in _name else 2)


@query("SELECT l_returnflag, round((sum(w * v * v) - pow(sum(w * v), 2) / sum(w)) / (sum(w) - 1), 0) AS l_extendedprice FROM (SELECT l_returnflag, l_extendedprice AS v, cos(radians(l_quantity)) AS w FROM lineitem) GROUP BY 1")
def red_variance_weighted(spark, d):
    return out(reduce.variance(li_cells(spark, d), "l_quantity", "l_linestatus", weights=True), 0)


@query("SELECT round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 8) AS l_discount FROM lineitem")
def red_whole_domain(spark, d):
    g = reduce.mean(li_cells(spark, d, ("l_extendedprice", "l_discount")), weights=False)
    return g.df.select(rounded("l_extendedprice", 4).alias("l_extendedprice"), rounded("l_discount", 8).alias("l_discount"))


def _argument(name: str, order: str) -> None:
    @query(f"SELECT vec_id, pos::BIGINT AS v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v {order}, pos) AS n FROM emb) WHERE n = 1", "emb", name=f"red_{name}_first")
    def run(spark, d):
        return out(getattr(emb(spark, d), name)("pos"))


_argument("argmax", "DESC")
_argument("argmin", "ASC")


@query("SELECT DISTINCT month(day)::BIGINT AS month, day(day)::BIGINT AS day FROM li", "li")
def red_distinct_fields(spark, d):
    return out(reduce.distinct_fields(li_day(spark, d), "day", ["month", "day"]))


@query("SELECT vec_id, (pos // 8)::BIGINT AS bin, round(sum(v), 6) AS v, count(*)::BIGINT AS n FROM emb GROUP BY 1, 2", "emb")
def red_binned(spark, d):
    return out(reduce.binned(emb(spark, d), "pos", F.floor(F.col("pos") / 8)))


# Calendar

_BIN_SQL = {"clim": {"month": "month(d)", "day": "day(d)"}, "diurnal": {"hour": "hour(d)", "minute": "minute(d)", "second": "second(d)"}, "daily": {"year": "year(d)", "month": "month(d)", "day": "day(d)"}, "monthly": {"year": "year(d)", "month": "month(d)"}, "yearly": {"year": "year(d)"}, "seasonal": {"year": "year(d) + (month(d) = 12)::INT", "season": "(month(d) % 12) // 3 + 1"}}
_HOW_SQL = {"mean": "avg(v)", "nanmean": "coalesce(avg(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)", "stdev": "coalesce(CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE stddev_samp(CASE WHEN isnan(v) THEN NULL ELSE v END) END, 'NaN'::DOUBLE)", "nanstdev": "coalesce(stddev_samp(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE)", "count": "count(*) FILTER (NOT isnan(v))::DOUBLE"}


def _calendar(name: str, bins: str, how: str) -> None:
    short = bins in ("diurnal", "daily")
    source = "SELECT date_trunc('minute', time) AS d, event_type AS flag, CASE WHEN value > 400 THEN 'NaN'::DOUBLE ELSE value END AS v FROM ev" if short else "SELECT day AS d, flag, CASE WHEN day(day) = 13 AND month(day) = 5 AND flag = 'A' THEN 'NaN'::DOUBLE ELSE v END AS v FROM li"
    keys = _BIN_SQL[bins]
    named = ", ".join(f"({x})::BIGINT AS {k}" for k, x in keys.items())
    aggregate = "CASE WHEN bool_or(isnan(v)) THEN 'NaN'::DOUBLE ELSE avg(v) END" if how == "mean" else _HOW_SQL[how]
    by = ", ".join(str(i + 1) for i in range(len(keys) + 1))

    @query(f"SELECT {named}, flag, round({aggregate}, 4) AS v FROM ({source}) GROUP BY {by}", "ev" if short else "li", name=f"cal_{name}")
    def run(spark, d):
        if short:
            df = table(spark, d, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("flag"), F.when(F.col("value") > 400, float("nan")).otherwise(F.col("value")).alias("v"))
            g = grid(df, [ax.time("day"), ax.Axis("flag", "named")], "v")
        else:
            g = li_day(spark, d)
            hole = (F.dayofmonth("day") == 13) & (F.month("day") == 5) & (F.col("flag") == "A")
            g = g.with_df(g.df.withColumn("v", F.when(hole, float("nan")).otherwise(F.col("v"))))
        return out(calagg.OPERATIONS[name](g, "day"), 4)


for _bins, _names in calagg._WORDS.items():
    for _name, _how in zip(_names, _HOW_SQL, strict=True):
        _calendar(_name, _bins, _how)

_TREND = "t AS (SELECT month(day) AS m, day(day) AS dd, day, flag, v, (day - (SELECT min(day) FROM li)) * 86400.0 AS x FROM li)"


@query(f"WITH {grids.SQL['li']}, {_TREND} SELECT m::BIGINT AS month, dd::BIGINT AS day, flag, round(coalesce(regr_intercept(v, x), 'NaN'::DOUBLE), 3) AS intercept, round(coalesce(regr_slope(v, x), 'NaN'::DOUBLE) * 1e6, 4) AS slope FROM t GROUP BY 1, 2, 3")
def cal_climtrend(spark, d):
    g = li_day(spark, d).climtrend("day")
    return out(g.df.select("month", "day", "flag", rounded(npmath.back(F.col("intercept")), 3).alias("intercept"), rounded(npmath.back(F.col("slope")) * 1e6, 4).alias("slope")))


@query(f"WITH {grids.SQL['li']}, {_TREND}, c AS (SELECT m, dd, flag, regr_intercept(v, x) AS b, regr_slope(v, x) AS a FROM t GROUP BY 1, 2, 3), x AS (SELECT DISTINCT day, m, dd, x FROM t) SELECT x.day AS time, c.flag, round(c.a * x.x + c.b, 3) AS trend FROM x JOIN c ON x.m = c.m AND x.dd = c.dd WHERE c.a IS NOT NULL AND NOT isnan(c.a)")
def cal_from_trend(spark, d):
    g = li_day(spark, d)
    trend = g.climtrend("day")
    times = g.df.select(F.col("day").alias("time"))
    return out(trend.from_trend(times, "day", "time", calagg.first_second(g, "day")).df.where(F.col("trend").isNotNull()), 3)


@query(f"WITH {grids.SQL['li']}, {_TREND} SELECT day, flag, round(v - (regr_slope(v, x) OVER w * x + regr_intercept(v, x) OVER w), 3) AS v FROM t WINDOW w AS (PARTITION BY m, dd, flag)")
def cal_detrend(spark, d):
    return out(li_day(spark, d).detrend("day"), 3)


@query("SELECT day, flag, round(v - avg(v) OVER (PARTITION BY month(day), day(day), flag), 5) AS v FROM li", "li")
def cal_anomalies(spark, d):
    return out(li_day(spark, d).anomalies("day"), 5)


@query("SELECT min(day) AS day, flag, round(avg(v), 5) AS v FROM (SELECT l.*, i // 20 AS b FROM li l JOIN (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i FROM (SELECT DISTINCT day FROM li)) USING (day)) GROUP BY b, flag", "li")
def cal_time_average(spark, d):
    return out(li_day(spark, d).time_average(20, "day"), 5)


@query("SELECT ((year(day) * 365 + dayofyear(day) - CASE WHEN leap AND dayofyear(day) > 60 THEN 1 ELSE 0 END - 1)::BIGINT * 86400)::BIGINT AS day, flag, round(v, 6) AS v FROM (SELECT *, year(day) % 4 = 0 AND (year(day) % 100 <> 0 OR year(day) % 400 = 0) AS leap FROM li) WHERE NOT (leap AND dayofyear(day) = 60)", "li")
def cal_remove_leap(spark, d):
    return out(li_day(spark, d).remove_leap_days("day"))


@query("""SELECT y.year::BIGINT AS year, m.month::BIGINT AS month, m.dd::BIGINT AS day, y.flag, round(coalesce(l.v, 'NaN'::DOUBLE), 6) AS v FROM (SELECT DISTINCT year(day) AS year, flag FROM li) y CROSS JOIN (SELECT DISTINCT month(day) AS month, day(day) AS dd FROM li) m LEFT JOIN li l ON year(l.day) = y.year AND month(l.day) = m.month AND day(l.day) = m.dd AND l.flag = y.flag""", "li")
def time_split_year(spark, d):
    return out(shape.split_time(li_day(spark, d), "day"))


@query("SELECT day::TIMESTAMP AS time, flag, round(v, 6) AS v FROM li", "li")
def time_join_year(spark, d):
    g = shape.split_time(li_day(spark, d), "day")
    joined = shape.join_time(g, "year", "day_of_year", "time")
    return out(joined.df.where(~F.isnan("v")))


def _calendar_fields(name: str, sql: str) -> None:
    @query(f"WITH s AS (SELECT vec_id, vec_id * 3200001 + 86399 AS t FROM embeddings), f AS (SELECT *, t // 86400 AS days, t % 86400 AS rest FROM s) {sql}", name=f"cal_fields_{name}")
    def run(spark, d):
        t = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") * 3200001 + 86399).alias("t"))
        f = calendar.fields_of_seconds(F.col("t"), name)
        back = calendar.seconds_of_fields(f, name)
        return out(t.select("vec_id", *[c.alias(k) for k, c in f.items()], (back - F.col("t")).alias("off")))


_CLOCK = "(rest // 3600)::BIGINT AS hour, (rest // 60 % 60)::BIGINT AS minute, (rest % 60)::BIGINT AS second, 0::BIGINT AS off FROM f"
_calendar_fields("360", f"SELECT vec_id, (days // 360)::BIGINT AS year, (days % 360 // 30 + 1)::BIGINT AS month, (days % 30 + 1)::BIGINT AS day, {_CLOCK}")
_calendar_fields("365", f"SELECT vec_id, (days // 365)::BIGINT AS year, month(DATE '2001-01-01' + (days % 365)::INT)::BIGINT AS month, day(DATE '2001-01-01' + (days % 365)::INT)::BIGINT AS day, {_CLOCK}")
_calendar_fields("standard", f"SELECT vec_id, year(DATE '2000-01-01' + days::INT)::BIGINT - 2000 AS year, month(DATE '2000-01-01' + days::INT)::BIGINT AS month, day(DATE '2000-01-01' + days::INT)::BIGINT AS day, {_CLOCK}")


@query("SELECT time, strftime(time, '%b') || ' ' || day(time) || ', ' || year(time) || ' ' || strftime(time, '%H:%M:%S') AS a, strftime(time, '%B') || '/' || dayofyear(time) || '/' || strftime(time, '%y') || ' ' || ((hour(time) + 11) % 12 + 1) || lower(strftime(time, '%p')) AS b, (year(time) * 1000000 + month(time) * 10000 + day(time) * 100 + hour(time))::BIGINT AS n FROM (SELECT DISTINCT date_trunc('minute', time) AS time FROM ev)", "ev")
def time_format(spark, d):
    t = table(spark, d, "events").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time")).distinct()
    f = calendar.fields(F.col("time"))
    return t.select("time", calendar.formatted(f).alias("a"), calendar.formatted(f, "$B/$j/$y $I$p").alias("b"), calendar.encoded(f, True).alias("n"))


# Ordered axes

_E = "FROM emb WINDOW w AS (PARTITION BY vec_id ORDER BY pos)"


def _deriv(kind: str, sql: str) -> None:
    @query(f"SELECT vec_id, pos::BIGINT AS pos, round({sql}, 6) AS v {_E}", "emb", name=f"win_deriv_{kind}")
    def run(spark, d):
        g = emb(spark, d)
        return out(g.deriv("pos", "2" if kind == "second" else kind))


_deriv("centre", "(coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / (coalesce(lead(pos) OVER w, pos) - coalesce(lag(pos) OVER w, pos))")
_deriv("left", "coalesce(v - lag(v) OVER w, lead(v) OVER w - v)")
_deriv("right", "coalesce(lead(v) OVER w - v, v - lag(v) OVER w)")
_deriv("second", "coalesce(lead(v) OVER w - 2 * v + lag(v) OVER w, lead(v, 2) OVER w - 2 * lead(v) OVER w + v, v - 2 * lag(v) OVER w + lag(v, 2) OVER w)")


def _diff(n: int, sql: str) -> None:
    @query(f"SELECT * FROM (SELECT vec_id, pos::BIGINT AS pos, round({sql}, 6) AS v {_E}) WHERE v IS NOT NULL", "emb", name=f"win_diff{n}")
    def run(spark, d):
        return out(emb(spark, d).diff("pos", n))


_diff(1, "lead(v) OVER w - v")
_diff(2, "lead(v, 2) OVER w - 2 * lead(v) OVER w + v")
_diff(3, "lead(v, 3) OVER w - 3 * lead(v, 2) OVER w + 3 * lead(v) OVER w - v")


def _integral(name: str, term: str, along: str = "pos", **how) -> None:
    @query(f"SELECT vec_id, pos::BIGINT AS pos, round(sum(t) OVER (PARTITION BY vec_id ORDER BY {along} ROWS UNBOUNDED PRECEDING) + 1.5, 6) AS v FROM (SELECT vec_id, pos, coalesce({term}, 0) AS t FROM emb WINDOW w AS (PARTITION BY vec_id ORDER BY {along}))", "emb", name=f"win_integrate_{name}")
    def run(spark, d):
        return out(emb(spark, d).integrate("pos", v0=1.5, **how))


_integral("trapz", "0.5 * (v + lag(v) OVER w)", kind="trapz")
_integral("rectl", "lag(v) OVER w", kind="rectl")
_integral("rectr", "v * (lag(pos) OVER w - lag(pos) OVER w + 1)", kind="rectr")
_integral("reverse", "0.5 * (v + lag(v) OVER w)", "pos DESC", kind="trapz", order=-1)


@query("SELECT vec_id, pos::BIGINT AS pos, round(sum(v) OVER w, 6) AS v FROM emb WINDOW w AS (PARTITION BY vec_id ORDER BY pos ROWS UNBOUNDED PRECEDING)", "emb")
def win_cumsum(spark, d):
    return out(emb(spark, d).cumsum("pos"))


@query("SELECT vec_id, pos::BIGINT AS pos, round(sum(CASE WHEN pos = 63 THEN 2 ELSE v END) OVER w, 6) AS v FROM emb WINDOW w AS (PARTITION BY vec_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)", "emb")
def win_cumsum_after_reverse(spark, d):
    return out(emb(spark, d).cumsum("pos", 2.0, order=-1, mode="after"))


@query("SELECT day, round(sum(v) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS v FROM (SELECT day, avg(v) * 0.01234567::DOUBLE AS v FROM li GROUP BY 1)", "li")
def win_cumsum_one_line(spark, d):
    return out(reduce.mean(li_day(spark, d), "flag").scale(0.01234567).cumsum("day"), 2)


def _smooth(name: str, kernel) -> None:
    import numpy as np

    k = np.hanning(kernel) if isinstance(kernel, int) else np.asarray(kernel, float)
    k = k / k.sum()
    rows = ", ".join(f"({(len(k) - 1) // 2 - j}, {x!r}::DOUBLE)" for j, x in enumerate(map(float, k)) if x)
    at = "CASE WHEN e.pos + k.s < 0 THEN -(e.pos + k.s) - 1 WHEN e.pos + k.s > 63 THEN 127 - (e.pos + k.s) ELSE e.pos + k.s END"

    @query(f"SELECT e.vec_id, e.pos::BIGINT AS pos, round(sum(k.k * x.v), 6) AS v FROM emb e CROSS JOIN (VALUES {rows}) k(s, k) JOIN emb x ON x.vec_id = e.vec_id AND x.pos = {at} GROUP BY 1, 2", "emb", name=f"win_smooth_{name}")
    def run(spark, d):
        return out(emb(spark, d).smooth("pos", kernel))


_smooth("hanning7", 7)
_smooth("even_kernel", [1, 3, 2, 2])


@query("SELECT l.day, l.flag, k.k::BIGINT AS lag, round(coalesce(CASE k.k WHEN -2 THEN lag(v, 2) OVER w WHEN 0 THEN v ELSE lead(v, 3) OVER w END, 'NaN'::DOUBLE), 6) AS v FROM li l CROSS JOIN (VALUES (-2), (0), (3)) k(k) WINDOW w AS (PARTITION BY l.flag, k.k ORDER BY l.day)", "li")
def win_lag(spark, d):
    return out(li_day(spark, d).lag("day", [-2, 0, 3]))


@query(f"""WITH {grids.SQL['li']}, axis AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM li)), e AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM axis WHERE day(day) = 29 AND month(day) = 2)
SELECT e.n::BIGINT AS event, o.o::BIGINT AS "offset", f.flag, round(coalesce(l.v, 'NaN'::DOUBLE), 6) AS v FROM e CROSS JOIN (SELECT unnest(range(-3, 7)) AS o) o CROSS JOIN (SELECT DISTINCT flag FROM li) f LEFT JOIN axis x ON x.i = e.i + o.o LEFT JOIN li l ON l.day = x.day AND l.flag = f.flag""")
def win_composite(spark, d):
    g = li_day(spark, d)
    events = g.dimension("day").where((F.month("day") == 2) & (F.dayofmonth("day") == 29))
    return out(g.composite("day", events, 10, 3))


@query(f"SELECT vec_id, pos::BIGINT AS pos, v FROM (SELECT vec_id, pos, round((lead(v) OVER w - lag(v) OVER w) / 2, 6) AS v {_E}) WHERE pos BETWEEN 20 AND 30", "emb")
def win_halo(spark, d):
    return out(emb(spark, d).deriv("pos", within=(20, 30)))


@query("""SELECT e.vec_id, e.pos::BIGINT AS pos, round(sum(CASE WHEN h.k = 0 THEN 1 ELSE 2 END * (h.a * cos(2 * pi() * h.k * e.pos / 64) + h.b * sin(2 * pi() * h.k * e.pos / 64)) / 64), 6) AS v
FROM emb e JOIN (SELECT vec_id, k.k, sum(v * cos(2 * pi() * k.k * pos / 64)) AS a, sum(v * sin(2 * pi() * k.k * pos / 64)) AS b FROM emb CROSS JOIN (SELECT unnest(range(4)) AS k) k GROUP BY 1, 2) h ON h.vec_id = e.vec_id GROUP BY 1, 2""", "emb")
def win_fft_smooth(spark, d):
    return out(emb(spark, d).fft_smooth("pos", 4))


@query("SELECT a.vec_id, (a.pos + 0.5)::DOUBLE AS x, round((a.v + b.v) / 2, 6) AS v FROM emb a JOIN emb b ON a.vec_id = b.vec_id AND b.pos = a.pos + 1 UNION ALL SELECT DISTINCT vec_id, 63.5::DOUBLE, 'NaN'::DOUBLE FROM emb", "emb")
def interp_linear(spark, d):
    targets = spark.range(64).select((F.col("id") + 0.5).alias("x"))
    return out(emb(spark, d).interpolate("pos", targets, ax.Axis("x", "xaxis")))


@query("SELECT vec_id, -2.0::DOUBLE AS x, round(max(CASE WHEN pos = 0 THEN v END) - 2 * 0.25, 6) AS v FROM emb GROUP BY 1 UNION ALL SELECT vec_id, 65.5::DOUBLE, round(max(CASE WHEN pos = 63 THEN v END) + 2.5 * 0.75, 6) FROM emb GROUP BY 1", "emb")
def interp_linear_extrap(spark, d):
    targets = spark.createDataFrame([(-2.0,), (65.5,)], "x double")
    return out(emb(spark, d).interpolate("pos", targets, ax.Axis("x", "xaxis"), below=0.25, above=0.75))


@query()
def interp_cspline(spark, d):
    targets = spark.range(63).select((F.col("id") + 0.25).alias("x"))
    return out(emb(spark, d).interpolate("pos", targets, ax.Axis("x", "xaxis"), "cspline"))


@query()
def interp_akima(spark, d):
    targets = spark.range(63).select((F.col("id") + 0.25).alias("x"))
    return out(emb(spark, d).interpolate("pos", targets, ax.Axis("x", "xaxis"), "akima"))


@query()
def strans_power(spark, d):
    g = emb(spark, d).strans("pos", samples=9)
    return out(g.df.select("vec_id", "freq", "pos", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")))


# Put together

@query("SELECT vec_id, pos::BIGINT AS pos, round(CASE WHEN pos < 20 THEN v ELSE -v END, 6) AS v FROM emb", "emb")
def concat_axis(spark, d):
    g = emb(spark, d)
    return out(sets.concat(g(pos=(0, 19)), -g(pos=(20, 63))))


@query("SELECT 0::BIGINT AS ensemble, vec_id, pos::BIGINT AS pos, round(v, 6) AS v FROM emb UNION ALL SELECT 1::BIGINT, vec_id, pos::BIGINT, round(v * 2, 6) FROM emb", "emb")
def ensemble_axis(spark, d):
    g = emb(spark, d)
    return out(sets.ensemble(g, g.scale(2.0)))


@query("SELECT l_quantity, count(l_discount)::BIGINT AS a, count(l_tax)::BIGINT AS b FROM (SELECT l_quantity, l_discount, NULL AS l_tax FROM lineitem UNION ALL SELECT l_quantity, NULL, l_tax FROM lineitem) GROUP BY 1")
def concat_missing_vars(spark, d):
    t = table(spark, d, "lineitem")
    both = sets.union_missing([t.select("l_quantity", "l_discount"), t.select("l_quantity", "l_tax")])
    return both.groupBy("l_quantity").agg(F.count("l_discount").alias("a"), F.count("l_tax").alias("b"))


@query("SELECT p AS gap_start, d AS gap_end, (d - p - 1)::BIGINT AS missing FROM (SELECT d, lag(d) OVER (ORDER BY d) AS p FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE d - p > 1")
def gap_check(spark, d):
    return out(sets.gaps(table(spark, d, "orders"), "o_orderdate"))


@query("SELECT d FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders)) WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)")
def coverage_antijoin(spark, d):
    return sets.missing_dates(table(spark, d, "orders"), "o_orderdate")


# Shapes

@query("SELECT (e.r * 64 + pos)::BIGINT AS flat, round(v, 6) AS v FROM emb JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM (SELECT DISTINCT vec_id FROM emb)) e USING (vec_id)", "emb")
def shape_flatten(spark, d):
    return out(shape.flatten(emb(spark, d), "vec_id", "pos"))


@query("SELECT l_quantity, l_returnflag, l_linestatus, round(CASE WHEN isnan(v) THEN -1 ELSE v END, 6) AS l_extendedprice FROM holed", "holed")
def shape_fill(spark, d):
    return out(holed(spark, d).fill(-1))


@query("SELECT vec_id, (CASE WHEN pos >= 32 THEN pos * 5.625 - 360 ELSE pos * 5.625 END)::DOUBLE AS lon, round(v, 6) AS v FROM emb UNION ALL SELECT vec_id, 180.0::DOUBLE, round(v, 6) FROM emb WHERE pos = 32", "emb")
def shape_rotate_lon(spark, d):
    g = shape.replace_axis(emb(spark, d), "pos", ax.lon(), relabel=F.col("pos") * 5.625)
    return out(g.rotate_lon(-180.0, duplicate=True))


@query("SELECT c.c::BIGINT AS coef, vec_id, pos::BIGINT AS pos, round(v * pow(2, c.c), 6) AS coefs FROM emb CROSS JOIN (SELECT unnest(range(3)) AS c) c WHERE c.c <> 1", "emb")
def shape_coefs(spark, d):
    g = emb(spark, d)
    merged = shape.merge_coefs([g, g.scale(2.0), g.scale(4.0)])
    a, _, c = shape.split_coefs(merged)
    return out(sets.stacked([a, c], ax.Axis("half", "index")).df.select((F.col("half") * 2).alias("coef"), "vec_id", "pos", "coefs"))


@query("SELECT event_type, h AS hour, round(coalesce(v, 'NaN'::DOUBLE), 6) AS value FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN (SELECT DISTINCT date_trunc('hour', time) AS h FROM ev) LEFT JOIN (SELECT event_type AS t, date_trunc('hour', time) AS g, avg(value) AS v FROM ev GROUP BY 1, 2) ON t = event_type AND g = h", "ev")
def shape_densify(spark, d):
    df = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.avg("value").alias("value"))
    return out(shape.densify(grid(df, [ax.time("hour"), ax.Axis("event_type", "named")], "value"), "hour"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 3) AS l_extendedprice, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def dataset_map(spark, d):
    s = Dataset.of(li_cells(spark, d, ("l_extendedprice", "l_tax"))).map(reduce.mean, "l_quantity", "l_linestatus", weights=False)
    return s["l_extendedprice"].df.join(s["l_tax"].df, "l_returnflag").select("l_returnflag", rounded("l_extendedprice", 3).alias("l_extendedprice"), rounded("l_tax", 6).alias("l_tax"))


@query("SELECT vec_id, pos::BIGINT AS pos, round(7 * ln(1000.0 / (pos * 10 + 10)), 6) AS z, (pos * 10 + 10)::INT::VARCHAR || ' hPa' AS label FROM emb", "emb")
def shape_pressure(spark, d):
    g = emb(spark, d).df.withColumn("pres", F.col("pos") * 10.0 + 10)
    return out(g.select("vec_id", "pos", ax.log_pressure(F.col("pres")).alias("z"), ax.formatted(ax.pres(), F.col("pres"), "%d").alias("label")))


# Statistics

def _xy(spark, d) -> tuple[Grid, Grid]:
    df = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("flag")).agg(F.avg("l_quantity").alias("x"), F.avg("l_extendedprice").alias("y"))
    g = [ax.time("day"), ax.Axis("flag", "named")]
    return grid(df.select("day", "flag", "x"), g, "x"), grid(df.select("day", "flag", "y"), g, "y")


_XY = "xy AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS flag, avg(l_quantity) AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_XY} SELECT flag, round(corr(x, y), 8) AS r, round(corr(x, y) * corr(x, y), 8) AS r2, count(*)::BIGINT AS n FROM xy GROUP BY 1")
def stat_correlate(spark, d):
    return out(stats.correlate(*_xy(spark, d), axes=["day"], output="r,r2,n"), 8)


@query(f"WITH {_XY} SELECT flag, round(regr_slope(y, x), 5) AS m, round(regr_intercept(y, x), 3) AS b, round(regr_r2(y, x), 8) AS r2, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)), 4) AS se, round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) / sqrt(regr_sxx(y, x)), 5) AS sm FROM xy GROUP BY 1")
def stat_regress(spark, d):
    g = stats.regress(*_xy(spark, d), axes=["day"], output="m,b,r2,se,sm")
    return g.df.select("flag", *[rounded(c, n).alias(c) for c, n in (("m", 5), ("b", 3), ("r2", 8), ("se", 4), ("sm", 5))])


@query("""WITH s AS (SELECT l_returnflag AS flag, sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS c, sum(l_quantity * l_extendedprice) AS e, sum(l_discount * l_extendedprice) AS f FROM lineitem GROUP BY 1)
SELECT flag, round((e * c - b * f) / (a * c - b * b), 4) AS b1, round((a * f - b * e) / (a * c - b * b), 2) AS b2 FROM s""")
def stat_multiple_regress2(spark, d):
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    a = [ax.Axis("l_orderkey", "index"), ax.Axis("flag", "named")]
    g = stats.regress_values(grid(rows, a, ("l_quantity", "l_discount", "l_extendedprice")), ["l_quantity", "l_discount"], "l_extendedprice", axes=["l_orderkey"], output="beta")
    return g.df.select("flag", rounded(F.col("beta")[0], 4).alias("b1"), rounded(F.col("beta")[1], 2).alias("b2"))


_DIFF = "SELECT l_linestatus, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS b, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag = 'A') AS s, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag = 'R') AS t, count(*) FILTER (l_returnflag = 'A') AS n, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY 1"


@query(f"SELECT l_linestatus, round(a - b, 4) AS d, round((s + t) * (s + t) / (s * s / (n - 1) + t * t / (m - 1)), 4) AS df FROM ({_DIFF})")
def stat_difference(spark, d):
    g = li_cells(spark, d)
    return out(stats.difference(g(s_l_returnflag="A"), g(s_l_returnflag="R"), ["l_quantity"], output="d,df"), 4)


_PAIR = "SELECT a.v - b.v AS z FROM li a JOIN li b ON a.day = b.day AND a.flag = 'A' AND b.flag = 'R'"


@query(f"SELECT round(avg(z), 4) AS d, (count(*) - 1)::DOUBLE AS df FROM ({_PAIR})", "li")
def stat_paired(spark, d):
    g = li_day(spark, d)
    side = lambda f: Grid(g.df.where(F.col("flag") == f).select("day", "v"), (g.axes[0],), ("v",), {})
    shared = lambda a, b: a.with_df(a.df.join(b.df.select("day"), "day", "left_semi"))
    a, b = side("A"), side("R")
    return out(stats.paired_difference(shared(a, b), shared(b, a), output="d,df").df, 4)


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS m, (count(*) - 1)::DOUBLE AS df FROM lineitem GROUP BY 1")
def stat_isnonzero(spark, d):
    return out(stats.isnonzero(li_cells(spark, d), ["l_quantity", "l_linestatus"], output="m,df"), 4)


@query()
def stat_p_values(spark, d):
    g = stats.regress(*_xy(spark, d), axes=["day"], output="p")
    h = stats.isnonzero(li_day(spark, d), ["day"], output="p,ci")
    return out(g.df.join(h.df.withColumnRenamed("p", "p_mean"), "flag"), 6)


@query()
def eof_eigenvalues(spark, d):
    m = modes.eof(emb(spark, d), 3, along=("vec_id",), weights=False)
    return out(m.eig.select(F.col("order"), rounded("eig", 4).alias("eig"), rounded("frac", 6).alias("frac")))


@query()
def eof_residual(spark, d):
    g = emb(spark, d)
    m = modes.eof(g, 3, along=("vec_id",), weights=False)
    rebuilt = m.eof.df.join(m.pc.df, "order").join(m.eig, "order").groupBy("vec_id", "pos").agg(F.sum(F.col("eof") * F.col("eig") * F.col("pc")).alias("r"))
    return out(g.df.join(rebuilt, ["vec_id", "pos"]).groupBy("pos").agg(F.sqrt(F.avg(F.pow(F.col("v") - F.col("r"), F.lit(2.0)))).alias("residual")), 4)


@query()
def svd_self(spark, d):
    g = emb(spark, d)
    c = modes.svd(g, g, 3, along=("vec_id",), weights=False)
    both = c.left.df.join(c.right.df.withColumnRenamed("eof", "other"), ["order", "pos"])
    return out(both.groupBy("order").agg(F.max(F.abs(F.abs("eof") - F.abs("other"))).alias("apart")).join(c.eig, "order"), 6)


# Sinks' arithmetic, and streams

@query("SELECT event_type, least(floor(value / 25), 19)::BIGINT AS bin, count(*)::BIGINT AS n FROM ev GROUP BY 1, 2", "ev")
def hist_value(spark, d):
    return stats.histogram(ev(spark, d), 25.0, most=19, by=["event_type"])


@query("SELECT event_type, round(quantile_cont(value, 0.0), 6) AS p0, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.98), 6) AS p98, round(quantile_cont(value, 1.0), 6) AS p100 FROM ev GROUP BY 1", "ev")
def pctl_range(spark, d):
    p = stats.percentiles(ev(spark, d), {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p98": 0.98, "p100": 1.0}, by=["event_type"])
    return out(p)


@query("WITH r AS (SELECT (max(value) - min(value)) / 65534 AS s, (max(value) + min(value)) / 2 AS o FROM events) SELECT event_id, round(trunc((value - o) / s) * s + o, 6) AS value FROM events, r")
def pack_roundtrip(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    g, how = cf.packed(grid(df, [ax.Axis("event_id", "index")], "value"))
    return out(g.df.select("event_id", cf.unpacked(F.col("value"), how).alias("value")))


@query("SELECT event_type, date_trunc('day', ts) AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def stream_daily_mean(spark, d):
    import uuid

    name = f"daily_{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    means = calmeans.windowed(stream, "ts", ["value"], ["event_type"], late="60 days")
    calmeans.run_available(means, name, "complete", named(spark, name))
    return out(spark.table(name).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("day"), "value"))
