import hashlib
import random
from collections import Counter

import pytest
import xxhash

from gridloom.llm import simhash, substrings

ROWS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def words_of(text):
    return (text or "").encode().split()


def texts(seed=3, n=120, vocab=400):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(vocab)
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([0, 3, 34, 35, 36, 80, 300]))]
        if i % 5 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[: rng.choice([34, 35, 50, 60])]
        if i % 17 == 0:
            w += ["spam"] * rng.choice([20, 35, 36, 90])
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out + out[:3] + ["", None, "  x y z", "a " * 40]


def brute_repeats(rows, width=35):
    seen = Counter()
    for _, t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_substrings_brute(spark, most):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], ROWS).repartition(5)
    got = substrings.repeated(df, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute_repeats(rows), key=key)


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_substrings_crowded_sketch_loses_none(spark, most, monkeypatch):
    monkeypatch.setattr(substrings, "cells_for", lambda n: 1 << 16 if most else 64)
    rows = list(enumerate(texts(seed=8, n=200)))
    df = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], ROWS)
    got = substrings.repeated(df, depth=1, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows))


def test_substrings_rows_of_one_id(spark):
    """Rows with null ids, or with one id, are told apart by their texts; also a long text, and no text at all."""
    rng = random.Random(5)
    passage = " ".join("p%d" % i for i in range(40))
    rows = [(None, f"a{i} {passage}" if i % 2 else " ".join("q%d" % rng.randrange(10**6) for _ in range(41))) for i in range(60)]
    rows += [(7, f"b{i} {passage}") for i in range(3)] + [(8, " ".join("r%d" % i for i in range(400_000)) + " " + passage)] + [(9, None), (9, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], ROWS).repartition(6)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for most in (1 << 28, 0):
        got = substrings.repeated(df, most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute_repeats(rows), key=key)


def test_substrings_empty(spark):
    assert substrings.digest(spark.createDataFrame([], ROWS)).collect() == []


def brute_fingerprint(text, width=4):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(fps):
        for b, fb in fps[:i]:
            if (fa ^ fb).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, f"{f:016x}", find(d)) for d, f in fps)


def near_copies(seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        w = ["w%d" % rng.randrange(300) for _ in range(rng.choice([1, 2, 5, 40, 600]))]
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 4])):
            v = list(w)
            v[rng.randrange(len(v))] = "Other%d" % rng.randrange(9)
            out.append("  ".join(v).upper())
    return out + ["", None, "  \n", "ÉtÉ e"]


@pytest.mark.parametrize("most", [8192, 4])
def test_simhash_brute(spark, most, monkeypatch):
    rows = list(enumerate(near_copies()))
    df = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], ROWS).repartition(3)
    own = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, radius=4: own(fps, radius, most))
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_simhash_radius_of_bits(spark):
    rng = random.Random(1)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for k in (1, 3, 4, 5, 6):
            x = base
            for b in rng.sample(range(64), k):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "doc_id long, fp long")
    got = dict(simhash.grouped(df).select("doc_id", "component_id").collect())
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    assert got == dict(enumerate(root))


def test_simhash_empty_and_nulls(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], ROWS)).collect() == []
    df = spark.createDataFrame([(None, "a b", "", "", 1, ""), (4, "A b", "", "", 1, ""), (4, "A b", "", "", 1, ""), (None, None, "", "", 1, "")], ROWS)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert [(r[0], r[2]) for r in got] == [(4, 4), (4, 4), (None, 4), (None, None)] or sorted(r[2] is None for r in got) == [False, False, False, True]


def test_simhash_hot_group_and_long_text(spark):
    """A third of all rows empty, a star of near copies, a text of megabytes, repeated rows, clashing columns."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    stars = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        stars.append(" ".join(w))
    long = " ".join(f"n{i % 70_001}" for i in range(600_000))
    rows = [(i, None if i % 2 else " ") for i in range(120)] + [(1000 + i, t) for i, t in enumerate(stars)] + [(5000, long), (5000, long), (None, "alone in the world")]
    df = spark.createDataFrame([(d, t, "f", 1) for d, t in rows], "doc_id long, text string, fingerprint string, component_id int").repartition(6)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = brute_groups([(d if d is not None else -1, t) for d, t in rows])
    assert got - {(None, *x[1:]) for x in got if x[0] is None} == {x for x in want if x[0] != -1}
    assert simhash.near_duplicates(df).count() == len(rows)
