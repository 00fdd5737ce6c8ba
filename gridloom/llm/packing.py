"""Packing along a space-filling curve.

A document's vector is the mean of its token ids' random directions (ids hashed to a table of them), squashed into a
cube of `DIMS` sides; the place of its cell on the Hilbert curve through the cube is its key, and a hash of the
document parts those with equal keys, so that any number of copies can be dealt out. One pass over the texts
tokenizes, and writes ids and keys as a table in the shared folder; the keys' quantiles cut the curve into
stretches of about `STRETCH` ids (as many as there are shuffle partitions at least), and each document's ids move once, to its stretch. Along a stretch
documents stand in the order of their keys, end to end, and are cut every `length` ids: neighbours on the curve share
sequences. What is left at the end of a stretch is cut into powers of two, which need no padding.

Ids: those of the file's tokenizer for the text without adding special tokens, then `end`; a special token's string in a
text is that token, as the file says. Where the file is a byte-level BPE whose ids follow its merges, a second library
computes the same ids in a third of the time; it is used for texts in scripts that both libraries split alike, without
special tokens' strings and without very long runs, and the first one for all others.

Defined cases: a null text is an empty one and has only the end id; repeated rows are packed each, and parted by their
place in the table, so that any number of them can be dealt out; a null id is a value like any other; a text is tokenized
whole, with some 60 bytes for each of its bytes; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .common import bounded, mix64, steps, utf8

LENGTH, END, DIMS, BITS = 2048, 1, 3, 16
#: Ids of one task.
STRETCH = 1 << 24
_BUCKETS = 4096
_DIRECTIONS = np.random.default_rng(7).standard_normal((_BUCKETS, DIMS))
_TIE = 15
#: Longer words, or this much more white space than words need, go to the library whose time is not their square.
_RUN = 400
#: What lies outside the scripts and signs that both libraries split alike.
_OTHER = re.compile("[^\x00-\u02af\u0386-\u0481\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u22ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, others from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(path: str):
    """The second library's encoding of the same vocabulary; None where its ids could differ."""
    held = json.load(open(path, encoding="utf-8"))
    model, split = held["model"], held.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not held.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return None
    import tiktoken

    letters, vocab = byte_letters(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as packed unsigned integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.fast = ranked(path)

    def alike(self, text: str) -> bool:
        """Whether the second library gives the same ids in little time."""
        if self.fast is None or any(t in text for t in self.added):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if _OTHER.search(text):
                return False
        return len(text) <= _RUN or longest_run(text.encode("utf-8", "replace")) <= _RUN

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.alike(t):
                out[i] = self.fast.encode_to_numpy(t, disallowed_special=()).astype(self.dtype).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False) if rest else (), strict=True):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out


def longest_run(text: bytes) -> int:
    """Bytes of the longest run that is all of, or all without, the space, tab and line ends."""
    turns = np.flatnonzero(np.diff(np.frombuffer(text, np.uint8) > 32, prepend=True, append=True))
    return int(np.diff(turns, prepend=0, append=len(text)).max())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of cells given by whole coordinates, one row each (Skilling's transform)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] & np.uint64(1 << b)) != 0, t ^ np.uint64((1 << b) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def keys(ids: list[bytes], dtype: np.dtype) -> np.ndarray:
    """One place on the curve for each document's ids; without ids, the middle of the cube."""
    n = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), dtype)
    hashed = (mix64(np.arange(int(flat.max(initial=0)) + 1, dtype=np.uint64)) % np.uint64(_BUCKETS)).astype(np.int64)
    directions = _DIRECTIONS[hashed]
    total = np.zeros((len(n), DIMS))
    some = n > 0
    for d in range(DIMS if len(flat) else 0):
        total[some, d] = np.add.reduceat(np.ascontiguousarray(directions[:, d])[flat], (np.cumsum(n) - n)[some])
    mean = np.round(total / np.maximum(n, 1)[:, None], 6)
    return hilbert(np.minimum((np.tanh(2 * mean) + 1) * (1 << BITS - 1), (1 << BITS) - 1).astype(np.uint64))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end: int = END, stretch_ids: int = STRETCH) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    spark = df.sparkSession
    own = bounded(df).select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("tie"), id_col, text_col, F.monotonically_increasing_id()), F.lit(1 << _TIE)).alias("tie"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        last = np.array([end], enc.dtype).tobytes()
        for part in steps(batches, "text"):
            ids = enc.encode([t.decode("utf-8", "replace") for t in part.column("text").to_pylist()])
            key = (keys(ids, enc.dtype) << np.uint64(_TIE) | part.column("tie").to_numpy().astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), pa.array([len(x) // enc.dtype.itemsize + 1 for x in ids]), pa.array([x + last for x in ids], pa.binary())], names=["doc_id", "key", "n", "ids"])

    id_type = own.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        size = dtype.itemsize
        crc = lambda b: zlib.crc32(np.frombuffer(b, dtype).astype("<u4").tobytes())
        open_: list[tuple] = []  # the pieces of the sequence that isn't full
        at = sequence = 0
        stretch = None

        def closed(cut: int) -> list[tuple]:
            """The open pieces as one sequence; those beyond `cut` ids stay open."""
            nonlocal open_, at, sequence
            out, place, rest = [], 0, []
            for doc, start, ids, total in open_:
                n = len(ids) // size
                here = max(0, min(n, cut - place))
                if here:
                    out.append((doc, start, here, crc(ids[: here * size]), total, stretch << 40 | sequence, place))
                    place += here
                if here < n:
                    rest.append((doc, start + here, ids[here * size :], total))
            open_, at, sequence = rest, at - place, sequence + 1
            return out

        def ended() -> list[tuple]:
            out = []
            open_.sort(key=lambda piece: -len(piece[2]))  # longest first: fewer are cut
            while at:
                out += closed(1 << at.bit_length() - 1)
            return out

        def row_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        kind = pa.int64()
        for batch in batches:
            kind, out = batch.schema.field("doc_id").type, []
            for doc, s, ids in zip(batch.column("doc_id").to_pylist(), batch.column("stretch").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if s != stretch:
                    out += ended()
                    stretch, sequence = s, 0
                total = len(ids) // size
                done = 0
                while done < total:
                    n = min(length - at, total - done)
                    open_.append((doc, done, ids[done * size : (done + n) * size], total))
                    at, done = at + n, done + n
                    if at == length:
                        out += closed(length)
            yield row_batch(out, kind)
        out = ended()
        if out:
            yield row_batch(out, kind)

    coded = stored(own.mapInArrow(encoded, f"doc_id {id_type}, key long, n long, ids binary"))
    total = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // stretch_ids))
    wanted = ", ".join(f"{i / parts!r}D" for i in range(1, parts))
    found = coded.agg(F.expr(f"percentile_approx(key, array({wanted}), {max(10_000, 20 * parts)})")).first()[0] if parts > 1 else None
    cuts = F.lit(found or []).cast("array<long>")  # one key a partition
    laid = coded.drop("n").withColumn("stretch", F.size(F.filter(cuts, lambda c: c < F.col("key")))).repartitionById(parts, F.col("stretch"))
    return laid.sortWithinPartitions("stretch", "key", "doc_id", "ids").mapInArrow(packed, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:]))
