"""SimHash near-dedup by deletion-variant signatures.

A text's fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words joined by spaces,
repeats included (fewer words: the whole sequence); h is a shingle's XXH64 with seed 42; a bit is 1 if it is set in
over half of the h. No words: fingerprint zero. Fingerprints link if `radius` bits or fewer differ.

Index: 64 bits are cut into radius // 2 + 1 segments, so that of two linked fingerprints one segment differs by one
bit at most. Each fingerprint is indexed under every segment with one bit deleted, 64 signatures in all; equal
signatures meet, and whole fingerprints are compared. Distinct fingerprints only: copies collapse beforehand.

Within a bucket no list of all pairs is made: what is linked is taken off the bucket as soon as it is reached, and
only the edges of a spanning forest leave it, each in the one bucket that is the first in which its ends meet.
Buckets of more than `most` fingerprints are dealt out in blocks, two blocks a task, each block against each other:
exact, with bounded groups. Components are found by alternating large and small stars, all in tables.

Defined cases: a null or empty text has fingerprint zero; repeated rows stay, each in its component; a null id takes
no part in the smallest id, and a component of null ids has a null component_id; a text takes some 20 bytes for each of its
bytes while it is hashed; other columns aren't looked at; an empty table gives an empty one.

All rows of one fingerprint, and all leaves of a star, meet their one partner in equi-joins, whose large partitions Spark
splits (`spark.sql.adaptive.skewJoin.enabled`, on by default); the tests hold such a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .common import bounded, steps, utf8

SEED, LANES = 42, np.uint64(0x0101010101010101)
#: A bucket with more fingerprints is dealt out in blocks of this many.
MOST = 8192
#: Shingles of a text that are Python numbers at a time.
_PART = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    line = b" ".join(text.lower().split())
    if not line:
        return np.zeros(0, np.uint64)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(spaces) < width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    starts, ends = np.append(0, spaces + 1)[: len(spaces) + 2 - width], np.append(spaces, len(line))[width - 1 :]
    digest = xxhash.xxh64_intdigest
    parts = []
    for at in range(0, len(starts), _PART):
        some = zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist(), strict=True)
        parts.append(np.fromiter((digest(line[a:b], SEED) for a, b in some), np.uint64))
    return np.concatenate(parts)


def fingerprints(texts: list[bytes], width: int = 4) -> np.ndarray:
    """One unsigned fingerprint a text."""
    return majority([shingle_hashes(t, width) for t in texts])


def majority(lists: list[np.ndarray]) -> np.ndarray:
    """One unsigned fingerprint a list of hashes. Set bits are counted in byte lanes, 255 hashes at a time."""
    n = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(len(lists), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    h = np.concatenate(lists)
    groups = -(-n[some] // 255)
    first = np.cumsum(groups) - groups
    base = np.cumsum(n[some]) - n[some]
    starts = np.repeat(base, groups) + 255 * (np.arange(groups.sum()) - np.repeat(first, groups))
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = (2 * counts > n[some][:, None]).astype(np.uint64)
        for j in range(8):
            out[some] |= bits[:, j] << np.uint64(8 * j + k)
    return out


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "__text"):
            fp = fingerprints(part.column("__text").to_pylist(), width)
            rest = [part.column(c) for c in part.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(fp.view(np.int64))], names=[*[c for c in part.schema.names if c != "__text"], "fp"])

    own = bounded(df).select(F.col(id_col), *also, utf8(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__text") + ", fp long"
    return own.mapInArrow(run, schema)


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each."""
    n = radius // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def first_meeting(diff: np.ndarray, radius: int) -> np.ndarray:
    """The lowest deleted bit under which two fingerprints with this difference have the same signature."""
    out = np.full(diff.shape, -1, np.int64)
    for low, width in reversed(segments(radius)):
        part = (diff >> np.uint64(low)) & np.uint64((1 << width) - 1)
        lone = np.bitwise_count((part & (~part + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        out = np.where(part == 0, low, np.where(np.bitwise_count(part) == 1, low + lone, out))
    return out


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that links fingerprints within `radius` bits."""
    one, two = [], []
    left, queue = np.arange(len(fp)), []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[at] ^ fp[left]) <= radius
            if near.any():
                got = left[near]
                one.append(np.full(len(got), at))
                two.append(got)
                queue.extend(got)
                left = left[~near]
        queue = []
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two)


def _bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges in buckets given as runs of equal keys: short runs by shifted comparison, long ones by their forests."""
    cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(np.append(cuts, len(key)))
    one, two = [], []
    small = np.repeat(sizes <= 32, sizes)
    for lag in range(1, min(33, len(key))):
        at = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= radius]
        one.append(at)
        two.append(at + lag)
    for start, size in zip(cuts[sizes > 32], sizes[sizes > 32], strict=True):
        a, b = forest(fp[start : start + size], radius)
        one.append(a + start)
        two.append(b + start)
    if not one:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(one), np.concatenate(two)
    mine = first_meeting(fp[a] ^ fp[b], radius) == key[a] >> 32
    return fp[a[mine]], fp[b[mine]]


def _batch(a: np.ndarray, b: np.ndarray, late: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), late))], names=["a", "b", "late"])


def links(fps: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """(a, b): edges between distinct fingerprints whose components are those of all links. `fps` has one row each, column fp."""
    spans = segments(radius)
    seg_of = [next((low, width) for low, width in spans if low <= b < low + width) for b in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = ", ".join(f"{signed(((1 << w) - 1 << low) & ~(1 << b))}L" for b, (low, w) in enumerate(seg_of)).replace("-9223372036854775808L", "bigint('-9223372036854775808')")
    shifts = ", ".join(str(low) for low, _ in seg_of)
    signed_key = f"shiftrightunsigned(fp & array({masks})[bit], array({shifts})[bit]) + shiftleft(cast(bit as bigint), 32)"
    signatures = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(F.expr(signed_key).alias("key"), "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            key, fp = np.concatenate([held_key, key]), np.concatenate([held_fp, fp])
            if over is not None:  # a bucket too large for a task goes on
                n = int(np.searchsorted(key, over, side="right"))
                yield _batch(key[:n].view(np.uint64), fp[:n], True)
                key, fp = key[n:], fp[n:]
                if not len(key):
                    held_key, held_fp = key, fp
                    continue
                over = None
            last = int(np.searchsorted(key, key[-1]))
            whole_key, whole_fp, held_key, held_fp = key[:last], fp[:last], key[last:], fp[last:]
            if len(held_key) > most:
                over = held_key[0]
                yield _batch(held_key.view(np.uint64), held_fp, True)
                held_key, held_fp = held_key[:0], held_fp[:0]
            yield from finished(whole_key, whole_fp)
        yield from finished(held_key, held_fp)

    def finished(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        sizes = np.diff(np.append(cuts, len(key)))
        large = np.repeat(sizes > most, sizes)
        if large.any():
            yield _batch(key[large].view(np.uint64), fp[large], True)
            key, fp = key[~large], fp[~large]
        if len(key):
            yield _batch(*_bucket_edges(key, fp, radius), False)

    first = stored(signatures.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long, late boolean"))
    found = first.where(~F.col("late")).select("a", "b")
    late = first.where("late").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = late.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("int").alias("blocks"))
    dealt = late.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = dealt.select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "fp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def pair(table: pa.Table) -> pa.Table:
        key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = forest(fp, radius)
        mine = first_meeting(fp[a] ^ fp[b], radius) == key[0] >> 32
        return pa.table({"a": fp[a[mine]].view(np.int64), "b": fp[b[mine]].view(np.int64)})

    return found.unionByName(dealt.groupBy("key", "low", "high").applyInArrow(pair, "a long, b long"))


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The alternating stars of `components` in memory, on edges with u > v: each node but the roots, with its root."""

    def distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        return u[new], v[new]

    def least(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For each edge, the smallest v of its u."""
        order = np.lexsort((v, u))
        return v[order][np.searchsorted(u[order], u)]

    u, v = distinct(u, v)
    while len(u):
        one, two = np.concatenate([u, v]), np.concatenate([v, u])
        up = two > one
        a, b = distinct(two[up], np.minimum(one, least(one, two))[up])
        m = least(a, b)
        a, b = distinct(np.concatenate([b[b != m], a]), np.concatenate([m[b != m], m]))
        if np.array_equal(a, u) and np.array_equal(b, v):
            break
        u, v = a, b
    return u, v


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """From edges (a, b) to (node, root), root the smallest node of the component; alternating large and small stars.
    Once `few` edges or less are left, the rounds run in one task."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            u, v = contracted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if 0 < mark[0] <= few:
            edges = stored(edges.coalesce(1).mapInArrow(alone, "u long, v long"))
        if mark == before or mark[0] <= few:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def grouped(rows: DataFrame, id_col: str = "doc_id", radius: int = 4) -> DataFrame:
    """Adds component_id to rows of (id, fp, ...)."""
    fps = stored(rows.groupBy("fp").agg(F.min(id_col).alias("__least")))
    roots = stored(components(links(fps.select("fp"), radius)))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "__least", F.coalesce("root", "fp").alias("__root"), F.col("root").isNotNull().alias("__linked"))
    least = named.where("__linked").groupBy("__root").agg(F.min("__least").alias("__all"))
    known = named.join(least, "__root", "left").select("fp", F.when(F.col("__linked"), F.col("__all")).otherwise(F.col("__least")).alias("component_id"))
    return rows.join(known, "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = stored(fingerprinted(df, id_col, text_col, width))
    out = grouped(rows, id_col, radius)
    return out.select(F.col(id_col).alias("doc_id"), hexadecimal("fp").alias("fingerprint"), "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
