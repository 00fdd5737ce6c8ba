"""Orthogonal modes: empirical orthogonal functions of one grid, coupled modes of two.

A line of the grid along the repeated axes (time) is a row, everything else a column of a matrix. The smaller of the
two Gram matrices is summed over the cluster: Arrow batches of whole rows give partial products in blocks, added by
key; only a matrix of at most `EXPLICIT` rows and columns reaches the driver. Larger ones go by subspace iteration,
whose state is (columns x modes) and is met with the rows by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.npmath import num
from ..grid import Grid
from ..shared import stored
from .reduce import weight

#: Sides up to this long are solved on the driver.
EXPLICIT = 4096
ROUNDS = 1000


@dataclass(frozen=True)
class Modes:
    """eof: patterns by order; pc: their series; eig: table of (order, eig, eig2, frac); var: total variance."""

    eof: Grid
    pc: Grid
    eig: DataFrame
    var: float


def _matrix(g: Grid, axes: list[Axis], weights) -> tuple[DataFrame, DataFrame, DataFrame, list[str], list[str]]:
    """Cells (r, c, v), v under the square root of the relative weights, with the tables of rows and columns."""
    rows = [c for a in axes for c in a.columns]
    columns = [c for a in g.axes if a not in axes for c in a.columns]
    w = weight(g, [a for a in g.axes if a not in axes], weights)
    number = lambda cols, name: g.df.select(*cols).distinct().withColumn(name, F.row_number().over(Window.orderBy(*cols)) - 1)
    r, c = number(rows, "__r"), number(columns, "__c")
    scale = F.lit(1.0)
    if w is not None:
        mean = g.df.select(*columns, w.alias("w")).distinct().agg(F.avg("w")).first()[0]
        scale = F.sqrt(w / mean)
    cells = g.df.withColumn("__s", scale).join(r, rows).join(c, columns).select("__r", "__c", (num(g.value) * F.col("__s")).alias("__v"), "__s")
    return cells, r, c, rows, columns


def gram(cells: DataFrame, along: str, across: str, n: int) -> np.ndarray:
    """Sums over `along` of the products of two `across`: partial products of batches of whole lines, added by row."""
    lines = cells.groupBy(along).agg(F.array_sort(F.collect_list(F.struct(across, "__v"))).alias("line"))

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((n, n))
        seen = False
        for batch in batches:
            line = batch.column("line")
            owner = np.repeat(np.arange(len(line)), np.diff(line.offsets.to_numpy()))
            flat = line.flatten()
            m = np.zeros((len(line), n))
            m[owner, flat.field(0).to_numpy()] = flat.field(1).to_numpy(zero_copy_only=False)
            total += m.T @ m
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(total))], names=["i", "row"])

    parts = lines.select("line").mapInArrow(partial, "i long, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "__x")).groupBy("i", "j").agg(F.sum("__x").alias("__x")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "__x"))).alias("row"))
    out = np.zeros((n, n))
    for r in summed.toLocalIterator():
        out[r.i] = [p["__x"] for p in r.row]
    return out


def eof(g: Grid, num_modes: int = 4, along=("time",), weights=True) -> Modes:
    """The leading modes. A pattern's first element isn't negative; eig is a singular value, pc has unit length."""
    axes = [g.axis(a) for a in along]
    cells, rtab, ctab, rows, columns = _matrix(g, axes, weights)
    cells = cells.persist()
    nr, nc, var = cells.agg(F.max("__r") + 1, F.max("__c") + 1, F.sum(F.col("__v") * F.col("__v"))).first()
    if min(nr, nc) > EXPLICIT:
        patterns = _subspace(cells, nc, num_modes)
    elif nc <= nr:
        _, vec = np.linalg.eigh(gram(cells, "__r", "__c", nc))
        patterns = _table(g, vec[:, ::-1][:, :num_modes], "__c")
    else:
        val, vec = np.linalg.eigh(gram(cells, "__c", "__r", nr))
        lead = np.sqrt(np.maximum(val[::-1][:num_modes], 1e-300))
        series = _table(g, vec[:, ::-1][:, :num_modes] / lead, "__r")
        patterns = cells.join(series, "__r").groupBy("__c", "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("__x"))
    first = F.first("__x").over(Window.partitionBy("order").orderBy("__c"))
    patterns = patterns.withColumn("__x", F.when(first < 0, -F.col("__x")).otherwise(F.col("__x")))
    scores = cells.join(patterns, "__c").groupBy("__r", "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("__p"))
    sizes = scores.groupBy("order").agg(F.sqrt(F.sum(F.col("__p") * F.col("__p"))).alias("eig")).persist()
    eig = sizes.select("order", "eig", (F.col("eig") * F.col("eig")).alias("eig2"), (F.col("eig") * F.col("eig") / var).alias("frac"))
    unscaled = patterns.join(cells.select("__c", "__s").distinct(), "__c").withColumn("eof", F.col("__x") / F.col("__s"))
    order = Axis("order", "order")
    eofs = Grid(unscaled.join(ctab, "__c").select("order", *columns, "eof"), (order, *[a for a in g.axes if a not in axes]), ("eof",), g.atts)
    pcs = Grid(scores.join(sizes, "order").withColumn("pc", F.col("__p") / F.nullif("eig", F.lit(0.0))).join(rtab, "__r").select("order", *rows, "pc"), (order, *axes), ("pc",), g.atts)
    return Modes(eofs, pcs, eig, var)


def _table(g: Grid, m: np.ndarray, key: str) -> DataFrame:
    """A matrix as (key, order from 1, x). At most EXPLICIT rows."""
    import pandas as pd

    n, k = m.shape
    return g.spark.createDataFrame(pd.DataFrame({key: np.repeat(np.arange(n), k), "order": np.tile(np.arange(1, k + 1), n), "__x": m.ravel()}))


def _orthonormal(table: DataFrame, k: int) -> DataFrame:
    """Columns of a tall table made orthonormal by the Cholesky factor of their k by k Gram matrix."""
    pairs = table.alias("a").join(table.withColumnRenamed("order", "o2").withColumnRenamed("__x", "x2"), "__c").groupBy("order", "o2").agg(F.sum(F.col("__x") * F.col("x2")).alias("p"))
    m = np.zeros((k, k))
    for r in pairs.collect():  # k * k numbers
        m[r.order - 1, r.o2 - 1] = r.p
    back = np.linalg.inv(np.linalg.cholesky(m + 1e-14 * np.trace(m) * np.eye(k))).T
    spark = table.sparkSession
    turn = spark.createDataFrame([(i + 1, j + 1, float(back[i, j])) for i in range(k) for j in range(k)], "order int, o2 int, w double")
    return table.join(F.broadcast(turn), "order").groupBy("__c", F.col("o2").alias("order")).agg(F.sum(F.col("__x") * F.col("w")).alias("__x"))


def _subspace(cells: DataFrame, nc: int, k: int, tol: float = 1e-6, rounds: int = ROUNDS) -> DataFrame:
    """Leading right singular vectors by subspace iteration, all state in tables."""
    spark = cells.sparkSession
    start = spark.range(nc).select(F.col("id").cast("int").alias("__c"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("order")).withColumn("__x", F.pmod(F.xxhash64("__c", "order"), F.lit(1 << 30)) / (1 << 29) - 1)
    held = stored(_orthonormal(start, k))
    before = None
    for _ in range(rounds):
        up = cells.join(held, "__c").groupBy("__r", "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("__p"))
        down = stored(cells.join(up, "__r").groupBy("__c", "order").agg(F.sum(F.col("__v") * F.col("__p")).alias("__x")))
        sizes = np.array([r.n for r in down.groupBy("order").agg(F.sqrt(F.sum(F.col("__x") * F.col("__x"))).alias("n")).orderBy("order").collect()])
        held = stored(_orthonormal(down, k))
        if before is not None and np.allclose(sizes, before, rtol=tol, atol=0):
            break
        before = sizes
    # the vectors inside the subspace
    up = cells.join(held, "__c").groupBy("__r", "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("__p"))
    m = np.zeros((k, k))
    for r in up.join(up.withColumnRenamed("order", "o2").withColumnRenamed("__p", "s2"), "__r").groupBy("order", "o2").agg(F.sum(F.col("__p") * F.col("s2")).alias("p")).collect():
        m[r.order - 1, r.o2 - 1] = r.p
    _, vec = np.linalg.eigh(m)
    vec = vec[:, ::-1]
    turn = spark.createDataFrame([(i + 1, j + 1, float(vec[i, j])) for i in range(k) for j in range(k)], "order int, o2 int, w double")
    return held.join(F.broadcast(turn), "order").groupBy("__c", F.col("o2").alias("order")).agg(F.sum(F.col("__x") * F.col("w")).alias("__x"))


def _times(cells: DataFrame, held: DataFrame, key: str, to: str) -> DataFrame:
    """(to, order, x): the matrix of cells, or its transpose, times a table over `key`."""
    return cells.join(held, key).groupBy(to, "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("__x"))


def _coupled(xa: DataFrame, xb: DataFrame, nb: int, n: int, k: int, tol: float = 1e-10, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, np.ndarray, float]:
    """Leading singular vectors and values of the cross-covariance by subspace iteration, the two tables of patterns
    alternating, and the sum of squares of all singular values."""
    spark, xa, xb = xa.sparkSession, stored(xa), stored(xb)
    to_left = lambda held: _times(xa, _times(xb, held, "__c", "__r"), "__r", "__c")
    to_right = lambda held: _times(xb, _times(xa, held, "__c", "__r"), "__r", "__c")
    start = spark.range(nb).select(F.col("id").cast("int").alias("__c"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("order")).withColumn("__x", F.pmod(F.xxhash64("__c", "order"), F.lit(1 << 30)) / (1 << 29) - 1)
    held, before = stored(_orthonormal(start, k)), None
    for _ in range(rounds):
        left = stored(to_left(held))
        m = np.zeros((k, k))
        for r in left.join(left.withColumnsRenamed({"order": "o2", "__x": "x2"}), "__c").groupBy("order", "o2").agg(F.sum(F.col("__x") * F.col("x2")).alias("p")).collect():  # k * k numbers
            m[r.order - 1, r.o2 - 1] = r.p
        val, vec = np.linalg.eigh(m)
        val, vec = val[::-1], vec[:, ::-1]
        if before is not None and np.allclose(val, before, rtol=tol, atol=tol * val[0]):
            break
        before = val
        held = stored(_orthonormal(to_right(left), k))
    else:
        raise ValueError(f"no convergence in {rounds} rounds")
    sizes = np.sqrt(np.maximum(val, 1e-300))

    def turned(table: DataFrame, by: np.ndarray) -> DataFrame:
        turn = spark.createDataFrame([(i + 1, j + 1, float(by[i, j])) for i in range(k) for j in range(k)], "order int, o2 int, w double")
        return table.join(F.broadcast(turn), "order").groupBy("__c", F.col("o2").alias("order")).agg(F.sum(F.col("__x") * F.col("w")).alias("__x"))

    if n <= EXPLICIT:
        total = float((gram(xa, "__c", "__r", n) * gram(xb, "__c", "__r", n)).sum())
    else:
        one, two = xa.select("__r", F.col("__c").alias("i"), F.col("__v").alias("a")), xb.select("__r", F.col("__c").alias("j"), F.col("__v").alias("b"))
        total = one.join(two, "__r").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
    scale = max(n - 1, 1)
    left, right = turned(left, vec / sizes), turned(held, vec)
    flip = left.where("__c = 0").select("order", F.when(F.col("__x") < 0, -1.0).otherwise(1.0).alias("__f"))
    left, right = (stored(t.join(F.broadcast(flip), "order").select("__c", "order", (F.col("__x") * F.col("__f")).alias("__x"))) for t in (left, right))
    return left, right, sizes / scale, total / scale**2


@dataclass(frozen=True)
class Coupled:
    left: Grid
    right: Grid
    left_pc: Grid
    right_pc: Grid
    eig: DataFrame


def _cross(xa: DataFrame, xb: DataFrame, na: int, nb: int) -> np.ndarray:
    """Sums over the rows of the products of two columns, one of either side."""
    lines = xa.groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("__c", "__v"))).alias("p")).join(xb.groupBy("__r").agg(F.array_sort(F.collect_list(F.struct("__c", "__v"))).alias("q")), "__r")

    def partial(batches):
        import pyarrow as pa

        total, seen = np.zeros((na, nb)), False
        for batch in batches:
            m = []
            for name, size in (("p", na), ("q", nb)):
                line = batch.column(name)
                owner = np.repeat(np.arange(len(line)), np.diff(line.offsets.to_numpy()))
                flat = line.flatten()
                one = np.zeros((len(line), size))
                one[owner, flat.field(0).to_numpy()] = flat.field(1).to_numpy(zero_copy_only=False)
                m.append(one)
            total += m[0].T @ m[1]
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(na)), pa.array(list(total))], names=["i", "row"])

    cross = np.zeros((na, nb))
    summed = lines.select("p", "q").mapInArrow(partial, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "__x")).groupBy("i", "j").agg(F.sum("__x").alias("__x"))
    for r in summed.toLocalIterator():
        cross[r.i, r.j] = r["__x"]
    return cross


def svd(a: Grid, b: Grid, num_modes: int = 4, along=("time",), weights=True, matrix: str = "cov") -> Coupled:
    """Coupled patterns of two grids over shared rows: singular vectors of their cross-covariance (`cor`: correlation)."""
    axes = [a.axis(x) for x in along]
    sides = []
    for g in (a, b):
        cells, _, ctab, rows, columns = _matrix(g, [g.axis(x.name) for x in axes], weights)
        w = Window.partitionBy("__c")
        v = F.col("__v") - F.avg("__v").over(w)
        cells = cells.withColumn("__v", v / F.nullif(F.stddev_samp("__v").over(w), F.lit(0.0)) if matrix == "cor" else v)
        sides.append((g, cells, ctab, rows, columns))
    (_, xa, ca, rows, cola), (_, xb, cb, _, colb) = sides
    na, nb, n = ca.count(), cb.count(), xa.agg(F.count_distinct("__r")).first()[0]
    if max(na, nb) > EXPLICIT:
        left, right, s, total = _coupled(xa, xb, nb, n, min(num_modes, na, nb))
    else:
        u, s, vt = np.linalg.svd(_cross(xa, xb, na, nb) / max(n - 1, 1), full_matrices=False)
        sign = np.where(u[0, :num_modes] < 0, -1.0, 1.0)
        left, right = _table(a, u[:, :num_modes] * sign, "__c"), _table(a, vt[:num_modes].T * sign, "__c")
        total = (s**2).sum()
    order = Axis("order", "order")
    out = []
    for (g, cells, ctab, rows, columns), pattern in zip(sides, (left, right), strict=True):
        own = [g.axis(x.name) for x in axes]
        eofs = pattern.join(cells.select("__c", "__s").distinct(), "__c").join(ctab, "__c").select("order", *columns, (F.col("__x") / F.col("__s")).alias("eof"))
        rtab = g.df.select(*rows).distinct().withColumn("__r", F.row_number().over(Window.orderBy(*rows)) - 1)
        pcs = cells.join(pattern, "__c").groupBy("__r", "order").agg(F.sum(F.col("__v") * F.col("__x")).alias("pc")).join(rtab, "__r").select("order", *rows, "pc")
        out.append((Grid(eofs, (order, *[x for x in g.axes if x not in own]), ("eof",), {}), Grid(pcs, (order, *own), ("pc",), {})))
    eig = a.spark.createDataFrame([(i + 1, float(x), float(x * x / total)) for i, x in enumerate(s[:num_modes])], "order int, eig double, frac double")
    return Coupled(out[0][0], out[1][0], out[0][1], out[1][1], eig)
