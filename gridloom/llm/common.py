"""What several of the operators share: reading tables, checkpoints, seeded keys, packed text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; numpy holds a few dozen times this.
STEP_BYTES = 1 << 18
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WHITE] = 0
_OTHER = np.random.default_rng(77100345).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER[_WHITE] = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """The same rows; batches to Python workers get a bound in bytes, where the session still has Spark's own of 64 MB."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "67108864b") == "67108864b":
        conf.set(name, str(BATCH_BYTES))
    return df


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def utf8(text_col: str) -> Column:
    """The text's bytes; null: empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in a row, and where each value starts and the last one ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text_col: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about `size` bytes of text each, one row at least."""
    for batch in batches:
        _, off = buffers(batch.column(text_col))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of many texts in one buffer, found without a Python loop.

    start, end: byte places; doc: the text's number; first: per text the number of its first word (one more at the end).
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        inside = ~_WHITE[buf]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        cuts = off[(off > 0) & (off < len(buf))]
        head[cuts] = inside[cuts]
        tail[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, other: bool = False) -> np.ndarray:
        """64 well-mixed bits a word; equal words, equal bits. `other`: those of an independent function."""
        if not len(self):
            return np.zeros(0, np.uint64)
        spans = np.diff(np.append(self.start, len(self.buf)))
        lead = self.start[0]
        place = np.arange(len(self.buf) - lead) - np.repeat(self.start - lead, spans)
        powers = np.full(int((self.end - self.start).max()) + 1, np.uint64(0xC2B2AE3D27D4EB4F) if other else _ODD)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        values = (_OTHER if other else _BYTE)[self.buf[lead:]]
        values *= powers[np.minimum(place, len(powers) - 1)]
        sums = np.add.reduceat(values, self.start - lead)
        return mix64(sums + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """For each run of `width` values its polynomial hash: sum of values[i + j] * factor**j, modulo 2**64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.full(len(values) + 1, np.uint64(factor))
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n, np.uint64(pow(factor, -1, 1 << 64)))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    total = np.zeros(len(values) + 1, np.uint64)
    np.add.accumulate(values * powers[:-1], out=total[1:])
    return mix64((total[width:] - total[:n]) * back)
