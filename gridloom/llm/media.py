"""Media columns: ISO base media files, written, walked and indexed without decoding a sample.

`store` puts each value's bytes, losslessly, into an ISO media file of one video track of raw 8-bit samples:
64 bytes a sample, 16 samples a chunk, the first of each chunk a sync sample. `probe` walks the nested boxes of
any ISO media file and turns the sample tables of each track into codec, duration and key frames' byte ranges;
it reads only the movie box, never a payload. `read_back` follows the same tables to the stored bytes.

Defined cases: a null value is stored as an empty one; an empty one has one sample of zero bytes. A null file, or
one without a movie box or with broken tables, has no tracks, and reads back null. Extra columns pass through;
a column that has an output's name is replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SAMPLE, PER_CHUNK, TIMESCALE, TICKS = 64, 16, 1000, 40
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta"}
TRACK = "struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,seconds:double,samples:long,media_bytes:long,key_offsets:array<long>,key_sizes:array<long>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(payload: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of the sample's size."""
    return payload + bytes(-len(payload) % SAMPLE or (0 if payload else SAMPLE))


def write_file(payload: bytes) -> bytes:
    """The same payload always gives the same file: all times are zero."""
    data = padded(payload)
    n = len(data) // SAMPLE
    ticks, chunks = n * TICKS, -(-n // PER_CHUNK)
    version = int(ticks >= 1 << 32)
    long = ">Q" if version else ">I"
    stamps = bytes(16 if version else 8)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, PER_CHUNK, 1)] if n % PER_CHUNK == 0 else [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, n % PER_CHUNK, 1)]

    def movie(base: int, wide: bool) -> bytes:
        places = base + np.arange(chunks, dtype=np.int64) * (SAMPLE * PER_CHUNK)
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(">I", chunks), (1 + PER_CHUNK * np.arange(chunks)).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        media = box(
            b"mdia",
            full(b"mdhd", stamps, struct.pack(">I", TIMESCALE), struct.pack(long, ticks), struct.pack(">HH", 0x55C4, 0), version=version),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"raw samples\0"),
            info,
        )
        head = full(b"tkhd", stamps, struct.pack(">II", 1, 0), struct.pack(long, ticks), bytes(16), _UNITY, struct.pack(">II", 8 << 16, 8 << 16), version=version, flags=7)
        return box(b"moov", full(b"mvhd", stamps, struct.pack(">I", TIMESCALE), struct.pack(long, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2), version=version), box(b"trak", head, media))

    brand = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    wide = len(data) + 64 * chunks >= 1 << 31
    shift = len(brand) + len(movie(0, wide)) + (16 if len(data) + 8 >= 1 << 32 else 8)
    return b"".join((brand, movie(shift, wide), box(b"mdat", data)))


def walk(buf: memoryview, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """The boxes from `at`: kind, and where the body starts and ends. Sizes of 0 (to the end) and 1 (64 bits) count."""
    end = len(buf) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", buf, at)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", buf, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box ends outside its parent")
        yield bytes(kind), at + head, at + size
        at += size


def _tables(buf: memoryview, at: int, end: int, found: dict) -> dict:
    for kind, start, stop in walk(buf, at, end):
        if kind in PARENTS:
            _tables(buf, start, stop, found)
        else:
            found.setdefault(kind, (start, stop))
    return found


def _column(buf: memoryview, span: tuple[int, int], skip: int, width: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", buf, span[0] + skip - 4)
    size = n * width * np.dtype(kind).itemsize
    if span[0] + skip + size > span[1]:
        raise ValueError("a table ends outside its box")
    return np.frombuffer(buf[span[0] + skip : span[0] + skip + size], kind).astype(np.int64).reshape(n, width)


def sample_ranges(buf: memoryview, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each sample's place and size, from the tables of chunks and sizes."""
    (size, n) = struct.unpack_from(">II", buf, t[b"stsz"][0] + 4)
    sizes = np.full(n, size, np.int64) if size else _column(buf, t[b"stsz"], 12, 1)[:, 0]
    chunks = _column(buf, t[b"stco"], 8, 1)[:, 0] if b"stco" in t else _column(buf, t[b"co64"], 8, 1, ">u8")[:, 0]
    runs = _column(buf, t[b"stsc"], 8, 3)
    if not len(runs) or not len(chunks):
        if n:
            raise ValueError("samples without chunks")
        return np.zeros(0, np.int64), sizes
    lengths = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    per = np.repeat(runs[:, 1], lengths)
    if len(per) != len(chunks) or per.sum() < n:
        raise ValueError("chunks and samples differ in number")
    chunk = np.repeat(np.arange(len(chunks)), per)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.diff(chunk, prepend=-1))
    return chunks[chunk] + before - np.repeat(before[first], np.diff(np.append(first, n))), sizes


def tracks(media: bytes | None) -> list[dict]:
    """What the movie box says of each track; the payload isn't touched. A file that can't be walked has none."""
    if not media:
        return []
    buf, out = memoryview(media), []
    try:
        for kind, start, stop in walk(buf):
            if kind != b"moov":
                continue
            for inner, a, b in walk(buf, start, stop):
                if inner != b"trak":
                    continue
                t = _tables(buf, a, b, {})
                late = buf[t[b"mdhd"][0]] == 1
                scale, ticks = struct.unpack_from(">IQ" if late else ">II", buf, t[b"mdhd"][0] + (20 if late else 12))
                track_id = struct.unpack_from(">I", buf, t[b"tkhd"][0] + (20 if buf[t[b"tkhd"][0]] == 1 else 12))[0]
                places, sizes = sample_ranges(buf, t)
                stts = _column(buf, t[b"stts"], 8, 2)
                ticks = ticks or int((stts[:, 0] * stts[:, 1]).sum())
                keys = _column(buf, t[b"stss"], 8, 1)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
                out.append(
                    {
                        "track_id": track_id, "handler": bytes(buf[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin1"), "codec": bytes(buf[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16]).decode("latin1"),
                        "timescale": scale, "duration": ticks, "seconds": ticks / scale if scale else None, "samples": len(sizes), "media_bytes": int(sizes.sum()),
                        "key_offsets": places[keys].tolist(), "key_sizes": sizes[keys].tolist(), "places": places, "sizes": sizes,
                    }
                )
    except (KeyError, IndexError, ValueError, struct.error):
        return []
    return out


def read_back(media: bytes | None) -> bytes | None:
    """The samples' bytes of the first track, in order."""
    found = tracks(media)
    if not found:
        return None
    places, sizes = found[0]["places"], found[0]["sizes"]
    joins = np.flatnonzero(np.append(True, places[1:] != places[:-1] + sizes[:-1])) if len(places) else np.zeros(0, int)
    ends = np.append(joins[1:], len(places)) - 1
    return b"".join(media[places[a] : places[b] + sizes[b]] for a, b in zip(joins, ends, strict=True))


def feature(found: list[dict]) -> str:
    """Each track in a line: codec, seconds, samples, and the key frames' ranges as place+size."""
    return "\n".join(f"codec={t['codec']};seconds={t['seconds']:.3f};samples={t['samples']};keys=" + ",".join(f"{a}+{n}" for a, n in zip(t["key_offsets"], t["key_sizes"], strict=True)) for t in found)


def store(df: DataFrame, text_col: str = "text", into: str = "media") -> DataFrame:
    @F.pandas_udf("binary")
    def written(values: pd.Series) -> pd.Series:
        return values.map(lambda v: write_file(bytes(v)))

    return df.withColumn(into, written(utf8(text_col)))


def probe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds `tracks`, an array with a struct of codec, duration and key-frame ranges for each track."""

    @F.pandas_udf(f"array<{TRACK}>")
    def seen(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [{k: x for k, x in t.items() if k not in ("places", "sizes")} for t in tracks(bytes(v) if v is not None else None)])

    return df.withColumn("tracks", seen(media_col))


def read(df: DataFrame, media_col: str = "media", payload: str = "payload") -> DataFrame:
    """Adds the stored bytes and `feature`, both from the file's own tables."""

    @F.pandas_udf("struct<payload:binary,feature:string>")
    def got(values: pd.Series) -> pd.DataFrame:
        rows = [bytes(v) if v is not None else None for v in values]
        return pd.DataFrame({"payload": [read_back(v) for v in rows], "feature": [feature(tracks(v)) for v in rows]})

    own = "__read"
    return df.withColumn(own, got(media_col)).withColumns({payload: F.col(f"{own}.payload"), "feature": F.col(f"{own}.feature")}).drop(own)


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads it back, and returns lengths, checksums and the feature of each."""
    own = df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("__text"))
    done = read(store(own, "__text", "__media"), "__media", "__payload")
    return done.select(
        "doc_id",
        F.length("__text").cast("long").alias("n_bytes"),
        F.length("__payload").cast("long").alias("payload_bytes"),
        F.sha2("__payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(__payload, greatest(length(__payload) - {SAMPLE - 1}, 1), {SAMPLE})")).alias("tail_crc32"),
        F.length("__media").cast("long").alias("media_bytes"),
        F.sha2("__media", 256).alias("media_sha256"),
        "feature",
    )
