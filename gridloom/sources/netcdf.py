"""netCDF classic files (versions 1, 2 and 5): whole files through Spark's binary reader, cells decoded in Arrow batches.

A file is one row of at most 2 GB; a dataset of many files is read in parallel. Coordinates are the variables named as
their dimensions, or positions. What attributes say of axes, scales and fill values is applied by `cf.decode`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..grid import Dataset, Grid
from . import cf, io

#: Fixed values of the format: big-endian kinds by number.
KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: A dense file is written by the driver: no more cells than this.
MOST = 50_000_000


@dataclass(frozen=True)
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    atts: dict
    kind: np.dtype
    begin: int
    record: bool


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    atts: dict
    variables: dict[str, Variable]
    record_size: int


class _Reader:
    def __init__(self, buf: bytes):
        if buf[:3] != b"CDF" or buf[3] not in (1, 2, 5):
            raise ValueError("not a netCDF classic file")
        self.buf, self.at, self.version = buf, 4, buf[3]

    def take(self, kind: str) -> int:
        (x,) = struct.unpack_from(kind, self.buf, self.at)
        self.at += struct.calcsize(kind)
        return x

    def count(self) -> int:
        return self.take(">Q" if self.version == 5 else ">I")

    def block(self, n: int) -> bytes:
        out = self.buf[self.at : self.at + n]
        self.at += n + -n % 4
        return bytes(out)

    def name(self) -> str:
        return self.block(self.count()).decode()

    def listed(self, tag: int) -> range:
        found, n = self.take(">I"), self.count()
        if found not in (0, tag):
            raise ValueError(f"list {found} where {tag} was due")
        return range(n if found else 0)

    def atts(self) -> dict:
        out = {}
        for _ in self.listed(ATTRIBUTES):
            name, kind = self.name(), np.dtype(KINDS[self.take(">I")])
            n = self.count()
            raw = self.block(n * kind.itemsize)
            values = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out


def header(buf: bytes) -> Header:
    r = _Reader(buf)
    records = r.count()
    dims = {}
    for _ in r.listed(DIMENSIONS):
        name = r.name()
        dims[name] = r.count()
    names, sizes = list(dims), list(dims.values())
    atts = r.atts()
    variables = {}
    for _ in r.listed(VARIABLES):
        name = r.name()
        ids = [r.count() for _ in range(r.count())]
        own, kind = r.atts(), np.dtype(KINDS[r.take(">I")])
        r.count()
        begin = r.take(">I" if r.version == 1 else ">Q")
        record = bool(ids) and sizes[ids[0]] == 0
        shape = tuple(records if sizes[i] == 0 else sizes[i] for i in ids)
        variables[name] = Variable(tuple(names[i] for i in ids), shape, own, kind, begin, record)
    slabs = [int(np.prod(v.shape[1:])) * v.kind.itemsize for v in variables.values() if v.record]
    size = sum(n + -n % 4 for n in slabs) if len(slabs) != 1 else slabs[0]
    return Header({k: n or records for k, n in dims.items()}, atts, variables, size)


def values(buf: bytes, h: Header, name: str) -> np.ndarray:
    v = h.variables[name]
    if not v.record:
        return np.frombuffer(buf, v.kind, int(np.prod(v.shape)), v.begin).reshape(v.shape)
    slab = int(np.prod(v.shape[1:])) * v.kind.itemsize
    rows = [np.frombuffer(buf, v.kind, slab // v.kind.itemsize, v.begin + i * h.record_size) for i in range(v.shape[0])]
    return np.concatenate(rows).reshape(v.shape) if rows else np.zeros(v.shape, v.kind)


def read(spark: SparkSession, path: str | Sequence[str], variables: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> Dataset:
    """All variables with dimensions, as a dataset; one grid a variable. Files differ in coordinates only."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("content")
    h = header(files.select(F.substring("content", 1, 1 << 20).alias("b")).first().b)
    wanted = variables or [n for n, v in h.variables.items() if v.dims and (v.dims != (n,)) and v.kind.kind != "S"]
    out = []
    for name in wanted:
        dims = h.variables[name].dims

        def cells(batches: Iterator[pa.RecordBatch], name=name, dims=dims) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column("content"):
                    buf = content.as_buffer()
                    own = header(memoryview(buf))
                    data = values(buf, own, name)
                    at = [values(buf, own, d).astype(float) if d in own.variables else np.arange(n, dtype=float) for d, n in zip(dims, data.shape, strict=True)]
                    inner = int(np.prod(data.shape[1:])) if data.ndim else 1
                    step = max(1, (1 << 20) // max(inner, 1))
                    for a in range(0, data.shape[0], step):
                        part = data[a : a + step]
                        mesh = np.meshgrid(at[0][a : a + step], *at[1:], indexing="ij")
                        yield pa.RecordBatch.from_arrays([*[pa.array(m.ravel()) for m in mesh], pa.array(part.astype(float).ravel())], names=[*dims, name])

        table = files.mapInArrow(cells, ", ".join(f"`{c}` double" for c in (*dims, name)))
        about: Mapping = {n: v.atts for n, v in h.variables.items()}
        out.append(cf.decode(table, about, list(dims), [name], tuple(ignore)))
    return Dataset.of(out, h.atts)


def encoded(arrays: Mapping[str, tuple[tuple[str, ...], np.ndarray, Mapping]], dims: Mapping[str, int], atts: Mapping | None = None) -> bytes:
    """A version 2 file of fixed-size variables: (dimensions, values, attributes) by name."""
    number = {np.dtype(v).newbyteorder(">"): k for k, v in KINDS.items()}
    text = lambda s: (lambda b: struct.pack(">I", len(b)) + b + bytes(-len(b) % 4))(s.encode())

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)

    def attributes(held: Mapping) -> bytes:
        parts = []
        for k, v in held.items():
            if isinstance(v, str):
                raw = v.encode()
                parts.append(text(k) + struct.pack(">II", 2, len(raw)) + raw + bytes(-len(raw) % 4))
            else:
                x = np.atleast_1d(np.asarray(v, ">i4" if isinstance(v, int) else ">f8"))
                parts.append(text(k) + struct.pack(">II", 4 if isinstance(v, int) else 6, x.size) + x.tobytes() + bytes(-x.nbytes % 4))
        return listed(ATTRIBUTES, parts)

    names = list(dims)
    stored = {n: np.ascontiguousarray(v, np.asarray(v).dtype.newbyteorder(">")) for n, (_, v, _) in arrays.items()}

    def head(begin: Mapping[str, int]) -> bytes:
        variables = []
        for n, (axes, _, own) in arrays.items():
            size = stored[n].nbytes
            variables.append(text(n) + struct.pack(">I", len(axes)) + b"".join(struct.pack(">I", names.index(a)) for a in axes) + attributes(own) + struct.pack(">IIQ", number[stored[n].dtype], min(size + -size % 4, 0xFFFFFFFF), begin[n]))
        return b"CDF\x02" + struct.pack(">I", 0) + listed(DIMENSIONS, [text(n) + struct.pack(">I", k) for n, k in dims.items()]) + attributes(atts or {}) + listed(VARIABLES, variables)

    at, begin = len(head(dict.fromkeys(arrays, 0))), {}
    for n, x in stored.items():
        begin[n] = at
        at += x.nbytes + -x.nbytes % 4
    return head(begin) + b"".join(x.tobytes() + bytes(-x.nbytes % 4) for x in stored.values())


def write(g: Grid, path: str, pack: bool = False, most: int = MOST) -> None:
    """One dense file, by the driver: for results, of `most` cells at the most. Larger grids go to Parquet."""
    how: dict = {}
    if pack:
        g, how = cf.packed(g)
    plain, about = cf.encode(Grid(g.df, g.axes, g.values, {**g.atts, **how}))
    names = [cf.fix_name(a.name) for a in g.axes]
    if (n := plain.count()) > most:
        raise ValueError(f"{n} cells; at most {most} fit one file")
    cells = plain.toPandas()
    coords = [np.unique(cells[c].to_numpy()) for c in names]
    at = tuple(np.searchsorted(c, cells[k].to_numpy()) for c, k in zip(coords, names, strict=True))
    arrays = {k: ((k,), c.astype(float), {a: x for a, x in about[k].items() if a != "ancillary_variables"}) for k, c in zip(names, coords, strict=True)}
    for v in map(cf.fix_name, g.values):
        full = np.full([len(c) for c in coords], cf.FILL if pack else np.nan, np.int16 if pack else float)
        full[at] = cells[v].to_numpy()
        arrays[v] = (tuple(names), full, about[v])
    with open(path, "wb") as f:
        f.write(encoded(arrays, dict(zip(names, map(len, coords), strict=True))))


io.register_reader("netcdf", read)
io.register_writer("netcdf", write)
