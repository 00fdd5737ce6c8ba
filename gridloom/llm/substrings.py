"""Substring dedup: every word in a window of `width` words that also starts elsewhere goes.

1. Sketch. A window's anchor is the smallest hash among its runs of `anchor` words, the leftmost of equals; equal
   windows at different places have equal anchors at different places. Each partition counts the places of its
   anchors in a count-min sketch (counters stop at 2); the sketches are merged block by block. A window's anchor count is
   never under the window's count, so a window whose counters are all 2 may be repeated and any other isn't: none is lost.
2. Exact. Only windows estimated repeated are grouped, by 96 bits of two rolling hashes over two independent hashes of
   all their words, with partial sums before the shuffle, so that a passage in a third of the documents is one row a
   partition. What comes out are the windows that the sketch took for repeated and that stand alone: their text and place.
3. Each text is read once more: estimated windows less those alone are the repeated ones.

The sketch has 8 cells an anchor, as many as the corpus needs. Up to `most` cells (64 MB in two rows) its merged bits are
broadcast; a larger one stays a table of cells, which the anchors meet in a join, and each text gets the places of its
estimated anchors: the same result.

Texts are told apart by 96 bits of two hashes of the whole text, not by ids: all windows of equal texts are repeated,
so none of theirs is ever alone. Of 10**13 windows, any two different ones have the same 96 bits with probability 0.001.

Defined cases: a null text has no words and stays null; shorter texts than a window keep all words; repeated rows
remove each other's words; ids and other columns are never looked at, and columns named as results are replaced; texts
are read in steps of 1 MB, a longer text in one, with some 100 bytes for each of its bytes; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded, buffers, rolling, steps, utf8
from .sketch import cell, cells_for, merged, twice

WIDTH, ANCHOR, DEPTH = 35, 8, 2
#: Cells of a sketch that is broadcast.
MOST = 1 << 28
_FACTOR, _FIRST, _SECOND = 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


class Windows:
    """The windows of many texts, by their first word's number, and the place of each one's anchor."""

    def __init__(self, part: pa.RecordBatch, column: str, width: int, anchor: int):
        self.words = words = Words(*buffers(part.column(column)))
        self.hash = words.hashes()
        n = len(words) - width + 1
        self.start = np.flatnonzero(words.doc[: max(n, 0)] == words.doc[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.runs = rolling(self.hash, min(anchor, width), _FACTOR)
        if not len(self.start):
            self.at = np.zeros(0, np.int64)
            return
        least, at = self.runs, np.arange(len(self.runs))
        span, want = 1, width - min(anchor, width) + 1
        while span < want:
            step = min(span, want - span)
            right = least[step:] < least[:-step]
            least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
            span += step
        self.at = at[self.start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of all anchors, and each window's number among them."""
        return np.unique(self.at, return_inverse=True)

    def estimated(self, part: pa.RecordBatch, bits: np.ndarray | None) -> np.ndarray:
        """The windows that may be repeated, by their first words: by the bits, or by the places that the texts come with."""
        places, back = self.anchors()
        if bits is not None:
            ok = twice(bits, self.runs[places])
        else:
            known = np.zeros(len(self.words) + 1, bool)
            known[lists(part.column("__anchors"), self.words)] = True
            ok = known[places]
        return self.start[ok[back]] if len(places) else self.start


def lists(column: pa.Array, words: Words) -> np.ndarray:
    """The words' numbers for lists of places in each text; null: none."""
    sizes = np.diff(column.offsets.to_numpy()) if not column.null_count else np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], sizes)


def _anchors(known: DataFrame, width: int, anchor: int, cells: int) -> DataFrame:
    """(__one, __two, __anchors): each text's anchors whose cell holds two or more, by a sketch that stays a table."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "__text"):
            w = Windows(part, "__text", width, anchor)
            at, _ = w.anchors()
            row = pa.array(w.words.doc[at])
            yield pa.RecordBatch.from_arrays([part.column("__one").take(row), part.column("__two").take(row), pa.array(cell(w.runs[at], 0, cells)), pa.array((at - w.words.first[w.words.doc[at]]).astype(np.int32))], names=["__one", "__two", "cell", "place"])

    own = known.select("__one", "__two", "__text").mapInArrow(places, "__one long, __two int, cell long, place int")
    again = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    return own.join(again, "cell").groupBy("__one", "__two").agg(F.collect_set("place").alias("__anchors"))


def repeated(df: DataFrame, text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, depth: int = DEPTH, most: int = MOST) -> DataFrame:
    """The table with n_words, n_removed, kept_sha256 and kept (the kept words joined by one space; null: null)."""
    spark = df.sparkSession
    known = bounded(df).drop("n_words", "n_removed", "kept_sha256", "kept").withColumn("__text", utf8(text_col)).withColumns({"__one": F.xxhash64("__text"), "__two": F.hash("__text")})
    size = known.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    cells = cells_for(2 * size // (6 * (width - min(anchor, width) + 2)))
    bits = None
    if cells <= most:

        def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for part in steps(iter([batch]), "__text"):
                w = Windows(part, "__text", width, anchor)
                yield w.runs[w.anchors()[0]]

        bits = spark.sparkContext.broadcast(merged(known.select("__text"), hashes, cells, depth)[0])
    else:
        known = known.join(_anchors(known, width, anchor, cells).withColumnsRenamed({"__one": "__a", "__two": "__b"}), (F.col("__one") == F.col("__a")) & (F.col("__two") == F.col("__b")), "left").drop("__a", "__b")
    held = lambda: None if bits is None else bits.value

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "__text"):
            w = Windows(part, "__text", width, anchor)
            start = w.estimated(part, held())
            if not len(start):
                continue
            one, two = rolling(w.hash, width, _FIRST)[start], rolling(w.words.hashes(other=True), width, _SECOND)[start]
            row = pa.array(w.words.doc[start])
            place = (start - w.words.first[w.words.doc[start]]).astype(np.int32)
            # windows of one slice that are alike leave it as one row
            _, first, many = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_counts=True) if len(np.unique(one)) < len(one) else (None, np.arange(len(one)), np.ones(len(one), np.int64))
            row = row.take(pa.array(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)[first]), pa.array((two[first] >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("__one").take(row), part.column("__two").take(row), pa.array(place[first]), pa.array(np.minimum(many, 2).astype(np.int32))],
                names=["one", "two", "__one", "__two", "place", "many"],
            )

    more = ["__anchors"] if bits is None else []
    rows = known.select("__one", "__two", "__text", *more).mapInArrow(candidates, "one long, two int, __one long, __two int, place int, many int")
    groups = rows.groupBy("one", "two").agg(F.sum("many").alias("many"), F.max("__one").alias("__one"), F.max("__two").alias("__two"), F.max("place").alias("place"))
    alone = groups.where("many = 1").groupBy("__one", "__two").agg(F.collect_list("place").alias("__alone"))
    alone = alone.select(F.col("__one").alias("__a"), F.col("__two").alias("__b"), "__alone")
    joined = known.join(alone, (F.col("__one") == F.col("__a")) & (F.col("__two") == F.col("__b")), "left").drop("__a", "__b", "__one", "__two")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "__text"):
            w = Windows(part, "__text", width, anchor)
            lone = np.zeros(len(w.words) + 1, bool)
            lone[lists(part.column("__alone"), w.words)] = True
            start = w.estimated(part, held())
            start = start[~lone[start]]
            edge = np.zeros(len(w.words) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.subtract.at(edge, start + width, 1)
            gone = np.cumsum(edge)[:-1] > 0
            texts = part.column("__text").to_pylist()
            first = w.words.first
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[first[1:]] - sums[first[:-1]]
            left = []
            for i, t in enumerate(texts):
                own = t.split()
                left.append(b" ".join(own if not removed[i] else [x for x, g in zip(own, gone[first[i] : first[i + 1]], strict=True) if not g]))
            out = {k: c for k, c in zip(part.schema.names, part.columns, strict=True) if k not in ("__alone", "__text", "__anchors")}
            out |= {"n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]), "kept": pa.array(left, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    fields = [f for f in joined.schema if f.name not in ("__alone", "__text", "__anchors")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_words long, n_removed long, kept_sha256 string, kept binary"
    done = joined.mapInArrow(kept, schema)
    return done.withColumn("kept", F.when(F.col(text_col).isNotNull(), F.decode("kept", "UTF-8")))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return repeated(own).select("doc_id", "n_words", "n_removed", "kept_sha256")
