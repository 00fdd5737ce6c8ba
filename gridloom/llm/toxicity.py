"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled documents: one on windows of ordinary text, one on the passages that
mark toxic text. Each window of `window` words is compressed with the ordinary dictionary and with the toxic one put
before it, at one level; the bytes that the second saves are the window's distance. Distances of `cut` and more add up,
over a power of the text's length. Cut, power and threshold are calibrated on labelled documents that neither dictionary
has seen; score is that sum / (that sum + threshold), so 0.5 is the threshold.

The toxic samples are, document by document, the words of toxic texts that are marked: that begin as over `RATIO` times
as many toxic documents as ordinary ones have words begin (or have that whole word), among beginnings in at least
`SHARE` of the toxic ones. Trained on whole toxic windows, the dictionary fills with what both kinds of text share.

Words are compressed as chains: each letter is written as a byte that depends on all letters before it in the word
(A-Z lower-cased, ASCII punctuation at its ends left out), so that the compressor's matches are beginnings of words, or
whole ones, and never an inner part that two words share. A window is followed by a fixed passage that both dictionaries
hold: the compressor seeks no matches in a block's last bytes and stores small blocks raw.

Fitting uses at most `toxic_rows` and `ordinary_rows` labelled rows, drawn by hashes of the id and then of the text, on
their whole texts; of the ordinary windows `WINDOWS` at most, drawn by hash. Every text is scored whole, in windows that
don't overlap. Defined cases: a null or empty text scores 0, as does one without letters or digits; without toxic or
ordinary examples every text scores 0; a null label or an id that is null in `labels` is no label; of repeated labels the
largest counts; repeated documents are scored each; a null id is in the fold of the empty text. A text takes some 100
bytes a byte while it is read. An empty table gives an empty one; a column named as the result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bounded, buffers, fold, mix64, steps, utf8

RATIO, SHARE = 40.0, 0.008
#: Lengths of beginnings, in bytes.
LENGTHS = range(5, 11)
WINDOWS, WINDOW, LEVEL = 40_000, 16, 6
_ODD = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Chain bytes: everything but white space.
_CODE = np.array([c for c in range(256) if c not in b" \t\n\v\f\r"], np.uint8)
_EDGE = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])


class Chains:
    """The chains of many texts: `line` has the words' chains with a space before and after each, at[i] the place of
    word i's space; first: per text the number of its first word. `prefix` and `place`: for each chain byte the hash of the word
    up to it and its place in the word."""

    def __init__(self, column: pa.Array):
        buf, off = buffers(column)
        words = Words(buf, off)
        kept = np.append(np.flatnonzero(~_EDGE[buf]), len(buf))
        before = np.searchsorted(kept, words.end) - 1
        start = kept[np.searchsorted(kept, words.start)] if len(words) else words.start
        some = start < words.end
        start, end = start[some], kept[np.maximum(before, 0)][some] + 1
        self.first = np.searchsorted(words.start[some], off)
        size = end - start
        self.ends = np.cumsum(size)
        self.place = np.arange(int(size.sum())) - np.repeat(self.ends - size, size)
        small = buf[np.repeat(start, size) + self.place]
        small = small + ((small >= 65) & (small <= 90)).astype(np.uint8) * np.uint8(32)
        longest = int(size.max(initial=1))
        up, down = np.full(longest, np.uint64(_ODD)), np.full(longest, np.uint64(pow(_ODD, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.append(np.uint64(0), np.cumsum(_VALUE[small] * down[self.place], dtype=np.uint64))
        self.prefix = mix64((total[1:] - np.repeat(total[self.ends - size], size)) * up[self.place])
        self.at = self.ends - size + np.arange(len(size))
        line = np.full(len(small) + len(size) + 1, 32, np.uint8)
        line[np.arange(len(small)) + np.repeat(np.arange(len(size)), size) + 1] = _CODE[(self.prefix >> np.uint64(33)) % np.uint64(len(_CODE))]
        self.line, self.at = line.tobytes(), np.append(self.at, len(line) - 1)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words' beginnings and of the whole words, and each one's word."""
        word = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        last = np.zeros(len(self.place), bool)
        last[self.ends - 1] = True
        begin = np.flatnonzero((self.place + 1 >= LENGTHS.start) & (self.place + 1 < LENGTHS.stop) & ~last)
        whole = self.prefix[self.ends - 1] ^ np.uint64(_ODD)
        return np.concatenate([self.prefix[begin], whole]), np.concatenate([word[begin], np.arange(len(self.ends))])

    def windows(self, text: int, width: int) -> list[bytes]:
        cuts = self.at[[*range(self.first[text], self.first[text + 1], width), self.first[text + 1]]].tolist()
        return [self.line[a : b + 1] for a, b in zip(cuts, cuts[1:], strict=False)]


def chains(texts: list[bytes]) -> Chains:
    return Chains(pa.array(texts, pa.binary()))


def distinct(texts: list[bytes]) -> list[bytes]:
    """The texts without those that are, by least hashes of their word pairs, copies of one before."""
    seen: set[tuple] = set()
    out = []
    for t in texts:
        w = t.split()
        pairs = {zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:], strict=False)} or {zlib.crc32(t)}
        h = np.fromiter(pairs, np.uint64, len(pairs))
        least = [int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min()) for m in (2654435761, 40503, 2246822519, 3266489917, 668265263, 374761393)]
        keys = [(i, least[i], least[i + 1]) for i in (0, 2, 4)]
        if not seen.intersection(keys):
            out.append(t)
        seen.update(keys)
    return out


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    ballast: bytes
    cut: int
    window: int
    threshold: float
    power: float = 0.0


def compressor(content: bytes, level: int = LEVEL):
    import zstandard

    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=256, dict_size=len(content), write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.one, self.two = compressor(model.ordinary), compressor(model.toxic + model.ordinary)
        self.bare = len(self.one(model.ballast)) - len(self.two(model.ballast))

    def distances(self, texts: Chains, text: int) -> list[int]:
        """Of each window, the bytes that the toxic dictionary saves."""
        one, two, ballast, bare = self.one, self.two, self.model.ballast, self.bare
        return [len(one(w + ballast)) - len(two(w + ballast)) - bare for w in texts.windows(text, self.model.window)]

    def scores(self, column: pa.Array) -> np.ndarray:
        model, n = self.model, len(column)
        if not model.toxic:
            return np.zeros(n)
        texts, (_, off) = Chains(column), buffers(column)
        s = np.array([sum(d for d in self.distances(texts, i) if d >= model.cut) for i in range(n)], float)
        s /= np.maximum(np.diff(off), 1) ** model.power
        return s / (s + model.threshold)

    def score(self, text: bytes) -> float:
        return float(self.scores(pa.array([text], pa.binary()))[0])


_scorers: dict[Model, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One is kept in a worker: two dictionaries with their tables, some megabytes."""
    if model not in _scorers:
        _scorers.clear()
        _scorers[model] = Scorer(model)
    return _scorers[model]


def marked(bad: list[bytes], good: list[bytes]) -> np.ndarray:
    """Hashes of the beginnings and words that mark toxic texts, sorted."""

    def count(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(chains([t]).grams()[0]) for t in texts]), return_counts=True)

    (h, n), (other, m) = count(bad), count(good)
    at = np.minimum(np.searchsorted(other, h), max(0, len(other) - 1))
    m = np.where(other[at] == h, m[at], 0) if len(other) else np.zeros(len(h), int)
    often = n >= max(3 if len(bad) >= 20 else 2, SHARE * len(bad))
    marks = h[often & ((n + 0.5) / (len(bad) + 1) > RATIO * (m + 0.5) / (len(good) + 1))]
    if not len(marks):
        order = np.lexsort((h, -(n + 0.5) / (m + 0.5)))
        marks = np.sort(h[order[n[order] > 1][:40]])
    return marks


def passages(texts: list[bytes], marks: np.ndarray) -> list[bytes]:
    """Of each text, the chains of its marked words."""
    out = []
    for t in texts:
        c = chains([t])
        h, word = c.grams()
        some = np.unique(word[np.isin(h, marks)])
        if len(some):
            out.append(b"".join(c.line[c.at[i] : c.at[i + 1]] for i in some) + b" ")
    return out


def train(toxic: list[bytes], ordinary: list[bytes], window: int = WINDOW, size: int = 1 << 14, toxic_size: int = 1 << 13, cuts: tuple[int, ...] = (2, 3, 4), powers: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6)) -> Model:
    """Dictionaries from three quarters of the texts; cut, power and threshold, those with the fewest errors, from the others."""
    import zstandard

    part = lambda texts, held: [t for t in texts if (zlib.crc32(t) % 4 == 0) == held]
    bad, good = distinct(part(toxic, False)), distinct(part(ordinary, False))
    nothing = Model(b"", b"", b"", cuts[0], window, 1.0)
    if not bad or not good:
        return nothing
    samples = passages(bad, marked(bad, good))
    windows = [w for t in good for w in chains([t]).windows(0, 2 * window)]
    windows = [windows[i] for i in np.random.default_rng(3).permutation(len(windows))[:WINDOWS]]

    def dictionary(samples: list[bytes], size: int, **how) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples, **how).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text to choose from: all of it
            return b"".join(samples)[-size:]

    base, own = dictionary(windows, size, k=64, d=8), dictionary(samples, toxic_size, k=16, d=6)
    if not own:
        return nothing
    held = [(t, y) for y, texts in ((1, toxic), (0, ordinary)) for t in part(texts, True)]
    best = Model(base, own, base[-96:], cuts[0], window, 1.0)
    judge = Scorer(best)
    seen = [(np.array(judge.distances(chains([t]), 0), int), max(1, len(t)), y) for t, y in held]
    found = []
    for cut in cuts:
        for power in powers:
            wrong, threshold = calibrated([(float(d[d >= cut].sum()) / n**power, y) for d, n, y in seen], cut)
            found.append((wrong, power, cut, threshold))
    _, power, cut, threshold = min(found)
    return Model(base, own, base[-96:], cut, window, threshold, power)


def calibrated(held: list[tuple[float, int]], cut: float) -> tuple[int, float]:
    """The fewest errors and the threshold that gives them, half-way to the next value; without examples of both, the cut."""
    if len({y for _, y in held}) < 2:
        return 0, cut
    s, y = (np.array(x, float) for x in zip(*held, strict=True))
    values = np.unique(s)
    middles = (values[1:] + values[:-1]) / 2
    if not len(middles):
        return len(held), cut
    wrong = np.array([((s >= t) != (y == 1)).sum() for t in middles])
    best = middles[wrong == wrong.min()]
    return int(wrong.min()), float(max(best[len(best) // 2], 1e-6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0, toxic_rows: int = 1500, ordinary_rows: int = 3000, window: int = WINDOW) -> Model:
    """Learns from labelled rows outside the held-out fold: bounded draws of ids, then of their rows."""
    spark = docs.sparkSession
    known = labels.where((fold(id_col, folds) != held_fold) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__mark"))
    drawn = []
    for mark, rows in ((1, toxic_rows), (0, ordinary_rows)):
        drawn += known.where(F.col("__mark") == mark).orderBy(F.xxhash64(F.lit("draw"), id_col), id_col).limit(rows).select(F.col(id_col).alias("__drawn"), "__mark").collect()
    if not drawn:
        return train([], [], window)
    ids = spark.createDataFrame(drawn, docs.select(F.col(id_col).alias("__drawn")).schema.add("__mark", T.IntegerType()))
    rows = docs.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__t")).join(F.broadcast(ids), F.col("__id") == F.col("__drawn"))
    got = rows.orderBy(F.xxhash64(F.lit("draw"), "__id"), F.xxhash64("__t"), "__t").limit(toxic_rows + ordinary_rows).select("__t", "__mark").collect()
    got = sorted(((bytes(r[0]), r[1]) for r in got), key=lambda x: (zlib.crc32(x[0]), x))
    return train([t for t, m in got if m == 1], [t for t, m in got if m == 0], window)


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the score, whole texts in steps of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(model)
        for part in steps(batches, "__text"):
            out = {k: c for k, c in zip(part.schema.names, part.columns, strict=True) if k != "__text"}
            out[into] = pa.array(own.scores(part.column("__text")))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kept = docs.drop(into)
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.DoubleType())])
    return bounded(docs).withColumn("__text", utf8(text_col)).select(*[F.col(f"`{c}`") for c in kept.columns], "__text").mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = scored(own, fit(own, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
