"""Labelled-grid analytics on Spark. Every operator is a function of this package and a method of `Grid`."""

from __future__ import annotations

from . import axes
from .axes import Axis
from .functions import npmath
from .grid import Dataset, Grid, grid
from .operators import align, calagg, harmonic, interp, modes, reduce, select, sets, shape, stats, windowed

_METHODS = {
    "select": select.select, "squeeze": select.squeeze, "taken": select.taken, "compare": select.compare, "sort": select.sort, "head": select.head,
    "min": reduce.min_, "max": reduce.max_, "sum": reduce.sum_, "nanmin": reduce.nanmin, "nanmax": reduce.nanmax, "nansum": reduce.nansum, "mean": reduce.mean, "nanmean": reduce.nanmean,
    "variance": reduce.variance, "nanvariance": reduce.nanvariance, "stdev": reduce.stdev, "nanstdev": reduce.nanstdev, "argmin": reduce.argmin, "argmax": reduce.argmax, "binned": reduce.binned,
    **{n: getattr(shape, n) for n in ("extend", "transpose", "rename", "rename_axes", "replace_axis", "as_type", "fill", "unfill", "scale", "rotate_lon", "split_coefs", "flatten", "split_time", "join_time", "densify", "weights", "aux_values", "format_values", "with_metadata")},
    **calagg.OPERATIONS, "climtrend": calagg.climtrend, "from_trend": calagg.from_trend, "detrend": calagg.detrend, "anomalies": calagg.anomalies, "time_average": calagg.time_average, "remove_leap_days": calagg.remove_leap_days,
    **{n: getattr(windowed, n) for n in ("deriv", "diff", "integrate", "cumsum", "smooth", "lag", "composite")},
    "fft_smooth": harmonic.fft_smooth, "strans": harmonic.strans, "interpolate": interp.interpolate, "eof": modes.eof, "svd": modes.svd, "correlate": stats.correlate, "regress": stats.regress, "difference": stats.difference, "histogram": stats.histogram, "percentiles": stats.percentiles, "limits": stats.limits, "paired_difference": stats.paired_difference, "isnonzero": stats.isnonzero,
}


def _unary(name: str):
    def run(g: Grid) -> Grid:
        return g.mapped(npmath.UNARY[name])

    run.__name__ = name
    return run


def _binary(name: str, swap: bool = False):
    def run(a: Grid, b) -> Grid:
        f = npmath.BINARY[name]
        return align.binary(a, b, (lambda x, y: f(y, x)) if swap else f)

    run.__name__ = name
    return run


_METHODS |= {n: _unary(n) for n in npmath.UNARY if n not in _METHODS} | {n: _binary(n) for n in npmath.BINARY if n not in _METHODS}
_METHODS["clip"] = lambda g, lo, hi: g.mapped(lambda c: npmath.clip(c, lo, hi))
for _name, _f in _METHODS.items():
    setattr(Grid, _name, _f)
    if not hasattr(Dataset, _name):
        setattr(Dataset, _name, lambda self, *a, __f=_f, **k: self.map(__f, *a, **k))
for _op, _name in {"add": "add", "sub": "sub", "mul": "mul", "truediv": "div", "mod": "mod", "pow": "pow"}.items():
    setattr(Grid, f"__{_op}__", _binary(_name))
    setattr(Grid, f"__r{_op}__", _binary(_name, True))
for _name in ("lt", "le", "gt", "ge"):
    setattr(Grid, f"__{_name}__", _binary(_name))
for _op, _name in {"neg": "neg", "pos": "pos", "abs": "abs"}.items():
    setattr(Grid, f"__{_op}__", _unary(_name))
Grid.__call__ = select.select
Grid.__getitem__ = select.sliced
concat, ensemble, interpolate, multiple_regress = sets.concat, sets.ensemble, interp.interpolate, stats.multiple_regress

__all__ = ["Axis", "Dataset", "Grid", "axes", "grid", "concat", "ensemble", "interpolate", "multiple_regress"]
