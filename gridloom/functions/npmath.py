"""Elementwise functions as Columns, with array semantics where Spark's own differ.

A missing value at an existing coordinate is NaN and stays NaN through arithmetic; NULL is a coordinate that is not on
the grid. Zero divisors give infinities or NaN instead of errors, remainders have the divisor's sign, logarithms of
zero and below are -inf and NaN, and comparisons with NaN are false (`ne`: true).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
LARGEST = 1.7976931348623157e308


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def num(x) -> Column:
    return col(x).cast("double")


def nn(x) -> Column:
    """NaN becomes NULL, which aggregates skip."""
    c = num(x)
    return F.when(~F.isnan(c), c)


def back(x: Column) -> Column:
    """NULL becomes NaN again."""
    return F.coalesce(x, F.lit(NAN))


def divide(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(b != 0, a / b).when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).when(a < 0, -INF)


def mod(a, b) -> Column:
    a, b = num(a), num(b)
    r = F.when(b != 0, a % b).when(b.isNotNull(), NAN)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def power(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when((a == 1) | (a == -1) & (F.abs(b) == INF), 1.0).otherwise(F.pow(a, b))


def _log(f: Callable[[Column], Column]) -> Callable:
    return lambda x: F.when(num(x) > 0, f(num(x))).when(num(x) == 0, -INF).when(num(x).isNotNull(), NAN)


def _pair(f: Callable) -> Callable:
    def run(a, b) -> Column:
        a, b = num(a), num(b)
        return F.when(F.isnan(a) | F.isnan(b), NAN).otherwise(f(a, b))

    return run


minimum, maximum = _pair(F.least), _pair(F.greatest)


def clip(x, lo, hi) -> Column:
    return F.when(F.isnan(num(x)), NAN).otherwise(F.least(F.greatest(num(x), num(lo)), num(hi)))


def nan_to_num(x) -> Column:
    c = num(x)
    return F.when(F.isnan(c), 0.0).when(c == INF, LARGEST).when(c == -INF, -LARGEST).otherwise(c)


def _compare(f: Callable[[Column, Column], Column], unordered: bool = False) -> Callable:
    def run(a, b) -> Column:
        a, b = num(a), num(b)
        odd = F.isnan(a) | F.isnan(b)
        return odd | f(a, b) if unordered else ~odd & f(a, b)

    return run


lt, le, gt, ge = (_compare(f) for f in (lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: a > b, lambda a, b: a >= b))
eq, ne = _compare(lambda a, b: a == b), _compare(lambda a, b: a != b, True)


def vsum(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(num, xs))


def vprod(*xs) -> Column:
    return reduce(lambda a, b: a * b, map(num, xs))


def complex_(re, im) -> Column:
    return F.struct(num(re).alias("re"), num(im).alias("im"))


_plain = lambda f: lambda x: f(num(x))

#: By name: functions of one column. The degree forms take or give degrees.
UNARY: dict[str, Callable] = {
    "neg": lambda x: -num(x), "pos": num, "abs": _plain(F.abs), "absolute": _plain(F.abs), "sign": _plain(F.signum), "exp": _plain(F.exp), "sqrt": _plain(F.sqrt), "log": _log(F.log), "log10": _log(F.log10),
    "sin": _plain(F.sin), "cos": _plain(F.cos), "tan": _plain(F.tan), "sinh": _plain(F.sinh), "cosh": _plain(F.cosh), "tanh": _plain(F.tanh),
    "arcsin": _plain(F.asin), "arccos": _plain(F.acos), "arctan": _plain(F.atan), "arcsinh": _plain(F.asinh), "arccosh": _plain(F.acosh), "arctanh": _plain(F.atanh),
    "deg2rad": _plain(F.radians), "rad2deg": _plain(F.degrees),
    "sind": lambda x: F.sin(F.radians(num(x))), "cosd": lambda x: F.cos(F.radians(num(x))), "tand": lambda x: F.tan(F.radians(num(x))),
    "arcsind": lambda x: F.degrees(F.asin(num(x))), "arccosd": lambda x: F.degrees(F.acos(num(x))), "arctand": lambda x: F.degrees(F.atan(num(x))),
    "nan_to_num": nan_to_num, "trunc": lambda x: F.when(F.isnan(num(x)) | (F.abs(num(x)) >= 2.0**53), num(x)).when(num(x) < 0, F.ceil(num(x)).cast("double")).otherwise(F.floor(num(x)).cast("double")),
    "isnan": lambda x: F.isnan(num(x)),
    "real": lambda z: col(z)["re"], "imag": lambda z: col(z)["im"], "conj": lambda z: complex_(col(z)["re"], -col(z)["im"]), "angle": lambda z: F.atan2(col(z)["im"], col(z)["re"]),
}

#: By name: functions of two columns.
BINARY: dict[str, Callable] = {
    "add": lambda a, b: num(a) + num(b), "sub": lambda a, b: num(a) - num(b), "mul": lambda a, b: num(a) * num(b), "div": divide, "mod": mod, "pow": power,
    "minimum": minimum, "maximum": maximum, "arctan2": lambda a, b: F.atan2(num(a), num(b)), "arctand2": lambda a, b: F.degrees(F.atan2(num(a), num(b))),
    "lt": lt, "le": le, "gt": gt, "ge": ge, "eq": eq, "ne": ne,
}
