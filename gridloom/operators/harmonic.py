"""Harmonic filters and the S-transform of lines along an axis."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..axes import Axis
from ..functions.npmath import num
from ..grid import Grid
from .index import line


def fft_smooth(g: Grid, which, harmonics: int) -> Grid:
    """Values rebuilt from the harmonics 0 to harmonics - 1 of each line: sums over the line's window, in the JVM."""
    axis = g.axis(which)
    whole = Window.partitionBy(*g.outer(axis))
    rows = g.df.withColumns({"__p": F.row_number().over(line(g, axis)) - 1, "__n": F.count(F.lit(1)).over(whole)})
    theta = 2 * math.pi * F.col("__p") / F.col("__n")
    out = {}
    for v in g.values:
        c, total = num(v), F.avg(num(v)).over(whole)
        for k in range(1, harmonics):
            a, b = F.sum(c * F.cos(theta * k)).over(whole), F.sum(c * F.sin(theta * k)).over(whole)
            factor = F.when(2 * k < F.col("__n"), 2.0).when(2 * k == F.col("__n"), 1.0).otherwise(0.0) / F.col("__n")
            total = total + factor * (a * F.cos(theta * k) + b * F.sin(theta * k))
        out[v] = total
    return g.with_df(rows.withColumns(out)).tidy()


def stockwell(x: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """A row a frequency bin: the line's spectrum, shifted and under a Gaussian as wide as the frequency."""
    n = len(x)
    spectrum = np.fft.fft(x)
    twice = np.concatenate([spectrum, spectrum])
    m = np.fft.fftfreq(n, 1.0 / n)
    out = np.empty((len(bins), n), complex)
    for i, f in enumerate(bins):
        out[i] = x.mean() if f == 0 else np.fft.ifft(twice[f : f + n] * np.exp(-2 * (math.pi * m / f) ** 2))
    return out


def strans(g: Grid, which, step: float = 1.0, least: float | None = None, most: float | None = None, samples: int | None = None) -> Grid:
    """S-transform: adds a frequency axis (cycles a unit of `step`) with real and imaginary parts. A line is one group."""
    axis = g.axis(which)
    outer, value, coord = g.outer(axis), g.value, axis.coordinate
    kinds = {f.name: f.dataType.simpleString() for f in g.df.schema}

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(coord)
        n = len(cells)
        lo = 0 if least is None else max(0, math.ceil(least * n * step - 1e-9))
        hi = n // 2 if most is None else min(n // 2, math.floor(most * n * step + 1e-9))
        bins = np.arange(lo, hi + 1)
        if samples and samples < len(bins):
            bins = np.unique(np.linspace(lo, hi, samples).round().astype(int))
        s = stockwell(cells[value].to_numpy(float), bins)
        out = {c: np.repeat(cells[c].iloc[0], s.size) for c in outer}
        out |= {"freq": np.repeat(bins / (n * step), n), coord: np.tile(cells[coord].to_numpy(), len(bins)), "re": s.real.ravel(), "im": s.imag.ravel()}
        return pd.DataFrame(out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in outer) + (", " if outer else "") + f"freq double, `{coord}` {kinds[coord]}, re double, im double"
    lines = g.df.groupBy(*outer) if outer else g.df.groupBy()
    return Grid(lines.applyInPandas(run, schema), (Axis("freq", "freq"), *g.axes), ("re", "im"), g.atts)
