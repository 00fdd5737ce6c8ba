"""The grid: a DataFrame with a row a cell, whose coordinate columns are described by axes. Nothing runs before an action."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .axes import Axis


def common_atts(*many: Mapping) -> dict:
    """What all have with equal values."""
    first, *rest = many
    return {k: v for k, v in first.items() if all(k in m and m[k] == v for m in rest)}


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    axes: tuple[Axis, ...]
    values: tuple[str, ...]
    atts: Mapping = field(default_factory=dict)

    @property
    def value(self) -> str:
        """The name of the only value column."""
        if len(self.values) != 1:
            raise ValueError(f"one value column is asked for, not {self.values}")
        return self.values[0]

    @property
    def keys(self) -> list[str]:
        return [c for a in self.axes for c in a.all_columns]

    @property
    def spark(self):
        return self.df.sparkSession

    def axis(self, which) -> Axis:
        """By position, name, kind or any ancestor kind, without regard to case."""
        if isinstance(which, Axis):
            which = which.name
        if isinstance(which, int):
            return self.axes[which]
        w = which.lower()
        for test in (lambda a: a.name == which, lambda a: a.name.lower() == w, lambda a: a.kind == w, lambda a: a.is_a(w)):
            for a in self.axes:
                if test(a):
                    return a
        raise KeyError(f"no axis {which!r} among {[a.name for a in self.axes]}")

    def has_axis(self, which) -> bool:
        try:
            self.axis(which)
        except (KeyError, IndexError):
            return False
        return True

    def outer(self, *but) -> list[str]:
        """Coordinate columns of the other axes."""
        gone = {self.axis(b).name for b in but}
        return [c for a in self.axes if a.name not in gone for c in a.all_columns]

    def with_df(self, df: DataFrame, **changes) -> Grid:
        return replace(self, df=df, **changes)

    def tidy(self) -> Grid:
        """Only coordinates and values, in that order."""
        return self.with_df(self.df.select(*self.keys, *self.values))

    def mapped(self, f: Callable[[Column], Column], names: Mapping[str, str] | None = None) -> Grid:
        """Each value column through `f`."""
        names = names or {}
        return self.with_df(self.df.select(*self.keys, *[f(F.col(v)).alias(names.get(v, v)) for v in self.values]), values=tuple(names.get(v, v) for v in self.values))

    def dimension(self, which) -> DataFrame:
        """The axis's distinct coordinates with its auxiliary columns."""
        return self.df.select(*self.axis(which).all_columns).distinct()

    def explain(self) -> None:
        self.df.explain("formatted")

    def load(self) -> Grid:
        """Kept in the executors' memory and disk from its first action on."""
        return self.with_df(self.df.persist())

    def get(self):
        """The cells on the driver, in the axes' order."""
        return self.df.select(*self.keys, *self.values).orderBy(*self.keys).toPandas()

    def scalar(self) -> float:
        if self.axes:
            raise ValueError("the grid has axes left")
        return self.df.select(*self.values).first()[0]


def grid(df: DataFrame, axes: Sequence[Axis], values: str | Sequence[str], atts: Mapping | None = None) -> Grid:
    values = (values,) if isinstance(values, str) else tuple(values)
    out = Grid(df, tuple(axes), values, dict(atts or {}))
    if missing := [c for c in [*out.keys, *values] if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return out.tidy()


@dataclass(frozen=True)
class Dataset:
    """Named grids. Names that clash get a number."""

    grids: Mapping[str, Grid]
    atts: Mapping = field(default_factory=dict)

    @classmethod
    def of(cls, grids: Iterable[Grid] | Grid | Dataset, atts: Mapping | None = None) -> Dataset:
        if isinstance(grids, Dataset):
            return grids
        out: dict[str, Grid] = {}
        for g in [grids] if isinstance(grids, Grid) else grids:
            for v in g.values:
                name, n = v, 1
                while name in out:
                    n += 1
                    name = f"{v}_{n}"
                out[name] = Grid(g.df.select(*g.keys, F.col(v).alias(name)), g.axes, (name,), g.atts)
        return cls(out, dict(atts or {}))

    def __getitem__(self, name: str) -> Grid:
        return self.grids[name]

    def __getattr__(self, name: str) -> Grid:
        if name.startswith("_") or name not in self.grids:
            raise AttributeError(name)
        return self.grids[name]

    def __contains__(self, name: str) -> bool:
        return name in self.grids

    def __iter__(self):
        return iter(self.grids.values())

    def __len__(self) -> int:
        return len(self.grids)

    def __add__(self, other) -> Dataset:
        return Dataset.of([*self, *Dataset.of(other)], self.atts)

    def __sub__(self, names: str | Sequence[str]) -> Dataset:
        gone = {names} if isinstance(names, str) else set(names)
        return replace(self, grids={k: g for k, g in self.grids.items() if k not in gone})

    def has_axis(self, which) -> bool:
        return any(g.has_axis(which) for g in self)

    def axis(self, which) -> Axis:
        return next(g for g in self if g.has_axis(which)).axis(which)

    def rename(self, **names: str) -> Dataset:
        return Dataset({names.get(k, k): g.with_df(g.df.withColumnRenamed(k, names.get(k, k)), values=(names.get(k, k),)) for k, g in self.grids.items()}, self.atts)

    def replaced(self, **grids: Grid) -> Dataset:
        return replace(self, grids=dict(self.grids) | {k: g.with_df(g.df.withColumnRenamed(g.value, k), values=(k,)) for k, g in grids.items()})

    def map(self, f: Callable[..., Grid], *args, **kwargs) -> Dataset:
        return Dataset.of([f(g, *args, **kwargs) for g in self], self.atts)

    def load(self) -> Dataset:
        return replace(self, grids={k: g.load() for k, g in self.grids.items()})

    def __call__(self, **selection) -> Dataset:
        """Each grid's selection by those keys that apply to it."""
        from .operators.select import applicable, select

        return Dataset.of([select(g, **applicable(g, selection)) for g in self], self.atts)
