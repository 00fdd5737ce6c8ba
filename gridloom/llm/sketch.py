"""Count-min sketches whose counters stop at 2: which hashes may have been seen twice.

Each partition counts the cells of its hashes; what it hands on are the cells' numbers, block by block; the owners of
the blocks add them up. A hash that was seen twice has a 2 in all of its cells: none is lost, some lone ones are taken
for repeated. `cells` gives the number of cells for so many hashes, a power of two; over `most` the caller must do
without the merged bits, as they travel to every executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shared import discard, stored
from .common import mix64

_SALT = [np.uint64(0), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]
BLOCK = 1 << 16
#: Bytes of blocks that come to the driver in one job.
FETCH = 4 << 20
#: Hashes of a partition that are counted before they are handed on.
_HELD = 1 << 21


def cells_for(hashes: int, per: int = 8, least: int = 1 << 20) -> int:
    return max(least, 1 << (per * max(hashes, 1) - 1).bit_length())


def cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix64(hashes ^ _SALT[row]) & np.uint64(cells - 1)).astype(np.int64)


def coarse(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def merged(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int, depth: int, whole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The merged sketch as bits, 1 for a counter of 2: `depth` rows of cells / 8 bytes; and, if `whole` isn't 0, 2**whole
    counters that go on counting, by the hashes' first bits. `hashes` gives the places' hashes of a batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, own = [], 0, np.zeros(1 << whole if whole else 0, np.int64)
        for batch in batches:
            for h in hashes(batch):
                held.append(h)
                n += len(h)
                if n >= _HELD:
                    h = np.concatenate(held)
                    yield from handed(h)
                    if whole:
                        own += np.bincount(coarse(h, whole), minlength=len(own))
                    held, n = [], 0
        if n:
            h = np.concatenate(held)
            yield from handed(h)
            if whole:
                own += np.bincount(coarse(h, whole), minlength=len(own))
        # counters: their blocks have negative numbers, with the places that aren't 0 and what they hold
        some = [(k, np.flatnonzero(part).astype(np.uint16), part) for k, part in enumerate(own.reshape(-1, min(BLOCK, max(1, len(own))))) if part.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k for k, _, _ in some], pa.int32()), pa.array([at.tobytes() for _, at, _ in some], pa.binary()), pa.array([part[at].tobytes() for _, at, part in some], pa.binary())], names=["block", "seen", "again"])

    def handed(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(depth):
            own, count = np.unique(cell(h, row, cells), return_counts=True)
            block = own // BLOCK
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            low = (own % BLOCK).astype(np.uint16)
            ends = np.append(cuts[1:], len(own))
            names = row * (cells // BLOCK) + block[cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([low[a:b][count[a:b] > 1].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())],
                names=["block", "seen", "again"],
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(0, np.uint8)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts.tobytes() if at < 0 else np.packbits(counts > 1, bitorder="little").tobytes()])], names=["block", "bits"])
        for batch in batches:
            for block, seen, again in zip(*(batch.column(k).to_pylist() for k in ("block", "seen", "again")), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at, counts = block, np.zeros(BLOCK, np.int64 if block < 0 else np.uint8)
                seen = np.frombuffer(seen, np.uint16)
                if block < 0:
                    counts[seen] += np.frombuffer(again, np.int64)
                    continue
                again = np.frombuffer(again, np.uint16)
                counts[seen] = np.minimum(counts[seen] + 1, 2)
                counts[again] = 2
        if at is not None:
            yield done()

    parts = df.mapInArrow(counted, "block int, seen binary, again binary")
    blocks = stored(parts.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, bits binary"))
    bits = np.zeros((depth, cells // 8), np.uint8)
    counts = np.zeros(1 << whole if whole else 0, np.int64)
    per = cells // BLOCK
    jobs = 1 + (bits.nbytes + counts.nbytes) // FETCH
    for r in blocks.coalesce(jobs).toLocalIterator():  # a job a partition; depth * cells / 8 bytes, and 8 a counter, in all
        if r.block < 0:
            own = counts[(-1 - r.block) * BLOCK :][:BLOCK]
            own += np.frombuffer(r.bits, np.int64)[: len(own)]
            continue
        at = (r.block % per) * (BLOCK // 8)
        bits[r.block // per, at : at + BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    discard(blocks)
    return bits, counts


def twice(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether all of its counters are 2."""
    ok = np.ones(len(hashes), bool)
    for row in range(len(bits)):
        c = cell(hashes, row, bits.shape[1] * 8)
        ok &= (bits[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return ok
