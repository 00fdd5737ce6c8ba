"""Near copies by SimHash, and by the exact similarity of their word shingles where fingerprints are too far apart.

A text's set: the distinct 64-bit hashes of its runs of `width` words (A-Z lower-cased, words as `simhash` reads them; fewer
words: the whole sequence).
Texts link if their sets' intersection is at least 4/5 of the union; texts without words link with each other.

First the method of `simhash`: a set's fingerprint has the bits set in over half of its hashes; fingerprints within
`RADIUS` bits meet under deletion-variant signatures, one set stands for each fingerprint and those of equal ones are held
against it; what is verified on the whole sets makes components by star contraction. Sets at the edge of that similarity
differ in some 10 bits, more than those signatures reach, so what still crosses between components is found by prefixes,
which miss no pair: in any order of all shingles, two sets of that similarity meet in the first
n - ceil(4n/5) + 1 shingles of either. The order is by rarity: shingles that a count-min sketch shows to stand in one
set only come first, and then nothing can meet under them; the others go by coarse counts (a miscount costs time, never a
link). Only sets with a shared shingle in their prefix are kept at all, for either way. Equal sets collapse beforehand.

In buckets of a shared shingle with `FEW` sets at most, all pairs of different components that the sizes allow are made and
verified: first by the parities of the sets (in how many of 1,024 classes of shingles their counts are odd in one only: at least that many
shingles are in one set only), what that allows on the whole sets, which travel for such pairs alone. In larger buckets
no list of pairs is made: the sets themselves travel, what is alike is taken off the bucket as soon as it is reached, and
only the edges of a spanning forest leave it. Buckets of more than `MOST` sets or `SHINGLES` shingles are dealt out in blocks, two
blocks a task, each block against each other.

The sketch has 4 cells a shingle up to `CELLS` (32 MB of bits), and so many are broadcast; with more shingles than that it
takes more of them for shared, and more is compared, with the same result.

Defined cases: null and empty texts and those without words are alike; a null id is larger than all others; repeated rows
and equal texts are one, and one row of them stays; a long text takes some 100 bytes a word while it is read; an empty table gives an empty one; columns of any names pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, stored, trimmed
from . import simhash
from .common import Words, bounded, buffers, rolling, steps, utf8
from .simhash import components
from .sketch import cells_for, coarse, merged, twice

#: Cells of the sketch at most, and the bits of the coarse counters' numbers.
CELLS, BITS = 1 << 28, 20
_FACTOR = 0xC6BC279692B5C323
#: Bits in which linked fingerprints differ at most.
RADIUS = 4
#: Sets of a bucket at most whose pairs are made one by one.
FEW = 64
#: Sets and shingles of a block of a larger bucket.
MOST, SHINGLES = 2048, 1 << 20
#: Pairs that one batch holds.
STEP = 1 << 18
#: A set's shingles before one that are looked at to make no pair twice.
EARLIER = 4
#: Classes of shingles whose counts' parities are kept of a set.
PARITY = 1024
#: Keys that are broadcast at most, to fetch the sets of pairs (8 MB); for more, sets and keys are shuffled.
KEYS = 1 << 20
#: Edges whose stars are contracted in one task (16 MB, a few times that while they are sorted); more go by tables, a few jobs a round.
EDGES = 1 << 20


def prefix_length(n: int) -> int:
    return n + (-4 * n // 5) + 1 if n else 0


def alike(shared: int, n: int, m: int) -> bool:
    """Whether sets of n and m with so many in common have a similarity of 4/5: shared / (n + m - shared) >= 4/5."""
    return 9 * shared >= 4 * (n + m)


def parity(s: np.ndarray) -> bytes:
    odd = np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    buf, off = buffers(column)
    small = buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)
    words = Words(small, off)
    runs = rolling(words.hashes(), width, _FACTOR)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(runs[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            line = b" ".join(small[i:j].tobytes() for i, j in zip(words.start[a:b], words.end[a:b], strict=True))
            out.append(np.array([xxhash.xxh64_intdigest(line)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def keyed(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, __mark, key, n, h, place, set, parity, fp) of every row: a key of its set, the set's size, and of sets with shingles in their prefix that
    others may have these, their places, the set as bytes, its parities and its fingerprint; nulls for other sets. Texts are hashed twice."""
    texts = bounded(df).select(utf8(text_col).alias("__text"))
    words = (texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // 6
    bits, counts = merged(texts, lambda batch: (s for part in steps(iter([batch]), "__text") for s in _sets(part.column("__text"), width)), min(cells_for(words, 4), CELLS), 1, BITS)
    shared = df.sparkSession.sparkContext.broadcast((bits, np.minimum(counts, (1 << 31) - 1).astype(np.int32)))  # at most CELLS / 8 and 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, counts = shared.value
        for part in steps(batches, "__text"):
            key, size, met, places, sets, odd, fp = [], [], [], [], [], [], []
            for s in _sets(part.column("__text"), width):
                key.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                size.append(len(s))
                k = prefix_length(len(s))
                again = twice(bits, s)
                lone = len(s) - int(again.sum())
                if lone >= k:
                    met.append(None), places.append(None), sets.append(None), odd.append(None), fp.append(None)
                    continue
                h = s[again]
                first = h[np.lexsort((h, counts[coarse(h, BITS)]))[: k - lone]]
                met.append(first.view(np.int64)), places.append(np.arange(lone, k, dtype=np.int32)), sets.append(s.tobytes()), odd.append(parity(s))
                fp.append(int(simhash.majority([s]).view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(met, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(sets, pa.binary()), pa.array(odd, pa.binary()), pa.array(fp, pa.int64())],
                names=[id_col, "__mark", "key", "n", "h", "place", "set", "parity", "fp"],
            )

    own = df.select(F.col(id_col), "__mark", utf8(text_col).alias("__text"))
    rows = stored(own.mapInArrow(run, f"`{id_col}` {own.schema[0].dataType.simpleString()}, __mark long, key long, n int, h array<long>, place array<int>, set binary, parity binary, fp long"))
    shared.destroy()
    trimmed(df.sparkSession)
    return rows


def _near(whole: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(a, b): the pairs to verify that SimHash gives: sets of one fingerprint, and of fingerprints that are linked."""
    fps = stored(whole.groupBy("fp").agg(F.min("key").alias("least")))
    spent.append(fps)
    same = whole.select("key", "fp").join(fps, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    p, q = (fps.select(F.col("fp").alias(c), F.col("least").alias(k)) for c, k in (("a", "p"), ("b", "q")))
    met = simhash.links(fps.select("fp"), RADIUS).join(p, "a").join(q, "b")
    return same.unionByName(met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def _places(whole: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, key, n, place, root): each set under the shingles of its prefix, with its component's root."""
    own = whole.select("key", "n", "h", "place").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    return own.select("key", "n", "root", F.explode(F.arrays_zip("h", "place")).alias("m")).select("m.h", "key", "n", "m.place", "root")


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows of those shingles under which more than one component meets, with the bucket's sets and shingles."""
    ends = rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).where("lo < hi")
    return stored(rooted.join(ends.select("h", "sets", "shingles"), "h"))


def _of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """The sets of these keys."""
    keys = keys.distinct()
    few = keys.limit(KEYS + 1).count() <= KEYS
    return sets.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that are alike; `spent` gets the table that can go once they are read."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("s", "t"))
            apart = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
            good = 9 * apart <= batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column(c)] for c in ("s", "t"))
            good = [alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    p, q = (sets.select(F.col("key").alias(k), F.col("n").alias(n), F.col("parity").alias(c)) for k, n, c in (("a", "n", "s"), ("b", "m", "t")))
    some = stored(pairs.select("a", "b").distinct().join(p, "a").join(q, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(likely, "a long, b long"))
    spent.append(some)
    own = _of(sets.select("key", "set"), some.select(F.explode(F.array("a", "b")).alias("key")))
    s, t = (own.select(F.col("key").alias(k), F.col("set").alias(c)) for k, c in (("a", "s"), ("b", "t")))
    return some.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


def _fits(n, m):
    """Sizes that allow a similarity of 4/5."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _crossing(rooted: DataFrame) -> DataFrame:
    """(a, b): all pairs that share a shingle of few sets in their prefixes, are in different components and may be alike by sizes and places.

    A pair is left out where the two also share one of the `EARLIER` shingles that come before in either's rows: it is
    made under that one, as any common shingle's bound by places is one on the whole sets' intersection, or linked in
    that one's forest."""
    line = Window.partitionBy("key").orderBy("place")
    rooted = rooted.withColumns({f"e{d}": F.lag("h", d).over(line) for d in range(1, EARLIER + 1)}).where(F.col("sets") <= FEW)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
            h = t.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            yield from made(t.slice(0, cut))
            left = t.slice(cut)
        if left is not None:
            yield from made(left)

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, key, n, place, root = (t.column(c).to_numpy() for c in ("h", "key", "n", "place", "root"))
        earlier = [t.column(f"e{d}") for d in range(1, EARLIER + 1)]
        two = [(e.fill_null(0).to_numpy(), e.is_valid().to_numpy()) for e in earlier]
        one = [np.where(there, e, h) for e, there in two]  # no shingle before is the bucket's own
        ends = np.searchsorted(h, h, side="right")
        rest = ends - np.arange(len(h)) - 1  # each row with the ones after it in its bucket
        total, at = np.cumsum(rest), 0
        while at < len(h):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, side="right")))
            some, at = np.arange(at, end), end
            i = np.repeat(some, rest[some])
            if not len(i):
                continue
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(rest[some]) - rest[some], rest[some])
            most = np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j])
            again = np.zeros(len(i), bool)
            for x in one:
                for y, there in two:
                    again |= (x[i] == y[j]) & there[j]
            good = (root[i] != root[j]) & ~again & _fits(n[i].astype(np.int64), n[j].astype(np.int64)) & (9 * most.astype(np.int64) >= 4 * (n[i].astype(np.int64) + n[j]))
            a, b = np.minimum(key[i[good]], key[j[good]]), np.maximum(key[i[good]], key[j[good]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rooted.repartition("h").sortWithinPartitions("h", "key").mapInArrow(pairs, "a long, b long")


def forest(key: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, odd: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that link what is alike in one bucket and not in one component before: those of a spanning forest.

    `odd`: a row of parities for each set."""
    one, two = [], []
    left, queue = np.arange(len(key)), []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        same = root[left] == root[at]
        queue.extend(left[same])
        left = left[~same]
        some = left[_fits(n[left], n[at])]
        most = np.minimum(n[some] - place[some], n[at] - place[at]) + np.minimum(place[some], place[at])
        some = some[9 * most >= 4 * (n[some] + n[at])]
        some = some[9 * np.bitwise_count(odd[some] ^ odd[at]).sum(axis=1, dtype=np.int64) <= n[some] + n[at]]
        if not len(some):
            continue
        own, others = sets[at], np.concatenate([sets[i] for i in some])
        found = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        shared = np.add.reduceat(found, np.cumsum(n[some]) - n[some], dtype=np.int64)
        got = some[9 * shared >= 4 * (n[some] + n[at])]
        one.append(np.full(len(got), key[at]))
        two.append(key[got])
        queue.extend(got)
        left = np.setdiff1d(left, got, assume_unique=True)
    if not one:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two)


def _forests(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges that link what is alike under shingles of more than `FEW` sets."""
    large = rooted.where(F.col("sets") > FEW)
    blocks = F.ceil(F.greatest(F.col("sets") / MOST, F.col("shingles") / SHINGLES)).cast("int")
    dealt = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.join(_of(sets.select("key", "set", "parity"), large.select("key")), "key")
    dealt = dealt.select("h", "key", "n", "place", "root", "set", "parity", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("block", "other")

    def link(t: pa.Table) -> pa.Table:
        key, n, place, root = (t.column(c).to_numpy().astype(np.int64) for c in ("key", "n", "place", "root"))
        odd = np.frombuffer(buffers(t.column("parity"))[0], np.uint64).reshape(-1, PARITY // 64)
        buf, off = buffers(t.column("set"))
        a, b = forest(key, n, place, root, odd, [buf[i:j].view(np.uint64) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("h", "low", "high").applyInArrow(link, "a long, b long")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One row a key of those that `keyed` gives, of sets that others may have shingles of."""
    return stored(rows.where("set is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "h", "place", "set", "parity", "fp")]))


def links(whole: DataFrame) -> DataFrame:
    """(a, b): edges between keys whose components are those of all links. `whole` as `distinct_sets` gives them.

    Those that SimHash finds come first; the buckets of shared shingles then link what is left in different components.
    """
    spent: list[DataFrame] = []
    near = stored(_verified(_near(whole, spent), whole, spent))
    trimmed(whole.sparkSession)
    rooted = _mixed(_places(whole, components(near, EDGES)))
    trimmed(whole.sparkSession)
    found = stored(_verified(_crossing(rooted), whole, spent).unionByName(_forests(rooted, whole)).unionByName(near).distinct())
    discard(near, rooted, *spent)
    trimmed(whole.sparkSession)
    return found


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of each component, with the columns of `df`: the one of the smallest id, of equal ids that of the
    smallest hash of its text. A component whose ids are all null keeps one row too."""
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = keyed(df.withColumn("__mark", mark), id_col, text_col, width)
    best = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__mark").alias("mark")))
    known = stored(rows.groupBy("key").agg(best.alias("best")))
    whole = distinct_sets(rows)
    discard(rows)
    roots = components(links(whole), EDGES)
    discard(whole)
    trimmed(df.sparkSession)
    named = known.join(roots, known["key"] == roots["node"], "left").select("best", F.coalesce("root", "key").alias("root"))
    keep = named.groupBy("root").agg(F.min("best").alias("best")).select(_text_of("best.id").alias("__id"), F.col("best.mark").alias("__mark"))
    own = df.withColumns({"__mark": mark, "__id": _text_of(id_col)})
    return own.join(keep, ["__id", "__mark"], "left_semi").dropDuplicates(["__id", "__mark"]).drop("__mark", "__id")


def _text_of(col: str) -> Column:
    """The id as text, one that no id has if null."""
    return F.when(F.col(col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(col).cast("string")))
