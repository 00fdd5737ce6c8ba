"""Two-variable statistics and tests over axes: sums are made by one aggregate, p-values on its few rows.

Pairs with a NaN are skipped (save in `multiple_regress`). `output` names the columns wanted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.npmath import NAN, nn, num
from ..functions.tdist import p_value, p_value_whole, t_quantile
from ..grid import Grid
from .align import aligned


def _paired(x: Grid, y: Grid, axes: Sequence):
    """Joined cells with columns x and y (NULL where either is NaN), the axes left and their columns."""
    joined, all_axes, (xc,), (yc,) = aligned(x, y, check=True)
    shared = [a for a in x.axes if y.has_axis(a.name) or any(a.related(b) for b in y.axes)]
    gone = [x.axis(a).name for a in axes] if axes else [a.name for a in shared]
    left = tuple(a for a in all_axes if a.name not in gone)
    keys = [c for a in left for c in a.all_columns]
    both = ~F.isnan(num(xc)) & ~F.isnan(num(yc))
    return joined.select(*keys, F.when(both, num(xc)).alias("x"), F.when(both, num(yc)).alias("y")), left, keys


def _agg(df, keys: list[str], *cols: Column):
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def _out(df, axes, keys, wanted: str | Sequence[str], columns: dict[str, Column]) -> Grid:
    names = [w.strip() for w in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    if odd := [n for n in names if n not in columns]:
        raise ValueError(f"no such outputs: {odd}; there are {list(columns)}")
    return Grid(df.select(*keys, *[columns[n].alias(n) for n in names]), axes, tuple(names), {})


def correlate(x: Grid, y: Grid, axes: Sequence = (), output="r,p") -> Grid:
    """r, r2, p (two-sided, N - 2 degrees) and n."""
    df, left, keys = _paired(x, y, axes)
    yc, xc = F.col("y"), F.col("x")
    s = _agg(df, keys, F.regr_sxy(yc, xc).alias("sxy"), (F.sqrt(F.regr_sxx(yc, xc)) * F.sqrt(F.regr_syy(yc, xc))).alias("ss"), F.regr_count(yc, xc).alias("n"))
    r = F.coalesce(F.col("sxy") / F.nullif("ss", F.lit(0.0)), F.lit(NAN))
    s = s.withColumn("r", r).withColumn("__t", F.abs("r") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)) / F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-8))))
    return _out(s, left, keys, output, {"r": F.col("r"), "r2": F.col("r") * F.col("r"), "p": F.when(F.isnan("r"), NAN).otherwise(p_value_whole(F.col("__t"), F.col("n") - 2)), "n": F.col("n").cast("long")})


def regress(x: Grid, y: Grid, axes: Sequence = (), n_fac: float | None = None, output="m,b,p") -> Grid:
    """y on x: slope m, intercept b, r2, p, sm (error of the slope), se (of the estimate), n."""
    df, left, keys = _paired(x, y, axes)
    yc, xc = F.col("y"), F.col("x")
    s = _agg(df, keys, F.regr_slope(yc, xc).alias("m"), F.regr_intercept(yc, xc).alias("b"), F.regr_r2(yc, xc).alias("r2"), F.regr_sxx(yc, xc).alias("sxx"), F.regr_sxy(yc, xc).alias("sxy"), F.regr_syy(yc, xc).alias("syy"), F.regr_count(yc, xc).alias("n"))
    nu = F.col("n") / (n_fac or 1.0) - 2
    se = F.sqrt(F.greatest(F.col("syy") - F.col("m") * F.col("sxy"), F.lit(0.0)) / F.when(nu > 0, nu))
    s = s.withColumns({"se": se, "nu": nu}).withColumn("sm", F.col("se") / F.sqrt(F.nullif("sxx", F.lit(0.0))))
    t = F.abs("m") / F.nullif("sm", F.lit(0.0))
    return _out(s, left, keys, output, {k: F.coalesce(F.col(k), F.lit(NAN)) for k in ("m", "b", "r2", "se", "sm")} | {"p": F.coalesce(p_value(F.coalesce(t, F.lit(NAN)), F.coalesce("nu", F.lit(NAN))), F.lit(NAN)), "n": F.col("n").cast("long")})


def multiple_regress(xs: Sequence[Grid], y: Grid, axes: Sequence = (), n_fac: float | None = None, output="beta,p") -> Grid:
    """y on several regressors without an intercept: beta, r2, p, sb, covb, se; an array each for beta, p, sb.

    Grids meet on their axes; values that are in one grid's rows already go to `regress_values`, which joins nothing.
    """
    g = y.with_df(y.df.withColumnRenamed(y.value, "__y"), values=("__y",))
    for i, x in enumerate(xs):
        joined, all_axes, left, right = aligned(g, x)
        names = [*g.values, f"__x{i}"]
        keys = [c for a in all_axes for c in a.all_columns]
        g = Grid(joined.select(*keys, *[num(c).alias(n) for c, n in zip([*left, *right], names, strict=True)]), all_axes, tuple(names), {})
    return regress_values(g, [f"__x{i}" for i in range(len(xs))], "__y", axes, n_fac, output)


def regress_values(g: Grid, xs: Sequence[str], y: str, axes: Sequence = (), n_fac: float | None = None, output="beta,p") -> Grid:
    """`multiple_regress` of one value column of a grid on others of it, row by row.

    The products' sums are one aggregate; the small systems are solved on its rows in Arrow batches.
    """
    gone = [g.axis(a) for a in axes] or list(g.axes)
    left = tuple(a for a in g.axes if a not in gone)
    keys = [c for a in left for c in a.all_columns]
    k = len(xs)
    x = [num(c) for c in xs]
    yc = num(y)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * yc).alias(f"c{i}") for i in range(k)]
    s = _agg(g.df, keys, *sums, F.sum(yc * yc).alias("yy"), F.sum(yc).alias("sy"), F.count(yc).alias("n"))
    row = s.select(*keys, F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)], *[F.col(f"c{i}") for i in range(k)], "yy", "sy", F.col("n").cast("double")).alias("__v"))

    @F.pandas_udf("struct<beta:array<double>,r2:double,p:array<double>,sb:array<double>,covb:array<double>,se:double>")
    def solve(rows: pd.Series) -> pd.DataFrame:
        from ..functions.tdist import two_sided

        out = []
        for v in rows:
            v = np.asarray(v, float)
            gram, rhs, (yy, sy, n) = v[: k * k].reshape(k, k), v[k * k : k * k + k], v[-3:]
            inverse = np.linalg.pinv(gram) if np.isfinite(gram).all() else np.full((k, k), np.nan)
            beta = inverse @ rhs
            rest = yy - rhs @ beta
            eff = n if n_fac is None else n / n_fac
            cov = rest * inverse / eff
            sb = np.sqrt(np.maximum(np.diag(cov), 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                p = two_sided(beta / sb, np.full(k, eff - k))
                r2 = 1 - rest / (yy - sy * sy / n)
            out.append((beta.tolist(), r2, p.tolist(), sb.tolist(), cov.ravel().tolist(), float(np.sqrt(max(rest, 0) / eff))))
        return pd.DataFrame(out, columns=["beta", "r2", "p", "sb", "covb", "se"])

    solved = row.select(*keys, solve("__v").alias("s"))
    aka = {"B": "beta"}
    names = [aka.get(n.strip(), n.strip()) for n in (output.split(",") if isinstance(output, str) else output)]
    return _out(solved, left, keys, names, {n: F.col(f"s.{n}") for n in ("beta", "r2", "p", "sb", "covb", "se")})


def _side(g: Grid, axes: Sequence, name: str, fac: float):
    gone = [g.axis(a) for a in axes if g.has_axis(a)] or list(g.axes)
    left = tuple(a for a in g.axes if a not in gone)
    keys = [c for a in left for c in a.all_columns]
    s = _agg(g.df, keys, F.avg(nn(g.value)).alias(f"m{name}"), F.var_samp(nn(g.value)).alias(f"v{name}"), F.count(nn(g.value)).alias(f"n{name}"))
    return s.withColumn(f"e{name}", F.floor(F.col(f"n{name}") / fac)), left, keys


def difference(x: Grid, y: Grid, axes: Sequence = (), alpha: float = 0.05, x_fac: float = 1, y_fac: float = 1, output="d,p") -> Grid:
    """Means of two samples that may have unequal variances: d, df, p, ci (half-width at 1 - alpha)."""
    (a, left, keys), (b, _, _) = _side(x, axes, "x", x_fac), _side(y, axes, "y", y_fac)
    s = a.join(b, keys) if keys else a.crossJoin(b)
    sx, sy = F.col("vx") / F.col("ex"), F.col("vy") / F.col("ey")
    ok = (F.col("ex") > 1) & (F.col("ey") > 1) & (F.col("vx") + F.col("vy") > 0)
    s = s.withColumns({"d": F.col("mx") - F.col("my"), "__s": F.when(ok, F.sqrt(sx + sy)), "df": F.coalesce(F.when(ok, F.pow(sx + sy, F.lit(2.0)) / (sx * sx / (F.col("ex") - 1) + sy * sy / (F.col("ey") - 1))), F.lit(NAN))})
    return _tested(s, left, keys, alpha, output)


def _tested(s, left, keys, alpha, output, centre: str = "d") -> Grid:
    t = F.coalesce(F.abs(centre) / F.col("__s"), F.lit(NAN))
    return _out(s, left, keys, output, {centre: F.coalesce(centre, F.lit(NAN)), "df": F.col("df"), "p": p_value(t, F.col("df")), "ci": t_quantile(F.lit(1 - alpha / 2), F.col("df")) * F.col("__s")})


def paired_difference(x: Grid, y: Grid, axes: Sequence = (), alpha: float = 0.05, n_fac: float = 1, output="d,p") -> Grid:
    """Mean of the differences of paired values: d, df, p, ci. The error is sqrt(s2 / (N - 1))."""
    df, left, keys = _paired(x, y, axes)
    s = _agg(df.withColumn("z", F.col("x") - F.col("y")), keys, F.avg("z").alias("d"), F.var_samp("z").alias("v"), F.count("z").alias("n"))
    s = s.withColumn("df", (F.floor(F.col("n") / n_fac) - 1).cast("double"))
    return _tested(s.withColumn("__s", F.sqrt(F.col("v") / F.when(F.col("df") > 0, F.col("df")))), left, keys, alpha, output)


def isnonzero(x: Grid, axes: Sequence = (), alpha: float = 0.05, n_fac: float = 1, output="m,p") -> Grid:
    """Whether a mean differs from 0: m, df, p, ci. The error is sqrt(s2 / N)."""
    s, left, keys = _side(x, axes, "x", n_fac)
    s = s.withColumns({"m": F.col("mx"), "df": (F.col("ex") - 1).cast("double"), "__s": F.sqrt(F.col("vx") / F.when(F.col("ex") > 1, F.col("ex")))})
    return _tested(s, left, keys, alpha, output, "m")


def histogram(g: Grid, width: float, low: float = 0.0, most: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): how many values lie in each bin of `width` from `low` on; those beyond bin `most` count in it. NaN lie in none."""
    v = num(g.value)
    at = F.floor((v - F.lit(float(low))) / F.lit(float(width)))
    at = at if most is None else F.least(at, F.lit(most))
    return g.df.where(~F.isnan(v) & v.isNotNull()).groupBy(*by, at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(g: Grid, shares: Mapping[str, float], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """A column for each share: the values' percentile, between two values in proportion. NaN don't count. The exact form keeps the
    distinct values of a group, with their counts, in one task; the other a summary of fixed size, exact to 1 in 10,000."""
    v = num(g.value)
    wanted = F.array(*[F.lit(float(x)) for x in shares.values()])
    p = F.percentile(v, wanted) if exact else F.percentile_approx(v, wanted, F.lit(10_000))
    return g.df.where(~F.isnan(v) & v.isNotNull()).groupBy(*by).agg(p.alias("__p")).select(*by, *[F.col("__p")[i].alias(n) for i, n in enumerate(shares)])


def limits(g: Grid, low: float = 0.02, high: float = 0.98, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """(by, low, high): the percentiles that a colour scale runs between."""
    return percentiles(g, {"low": low, "high": high}, by, exact)
