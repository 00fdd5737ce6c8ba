import random

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridloom import shared
from gridloom.llm import simhash, similar, sketch


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The smallest id of each component of exact similarities."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def texts(seed):
    """Chains of copies that drift, copies at the edge of 0.8, a common line, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    line = " the very same line that stands in every one of the texts of this corpus"
    out = ["", None, " \n", "one", "one", "One two", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(25):
        w = [word() for _ in range(rng.choice([6, 30, 80, 200]))]
        out.append(" ".join(w) + line)
        for _ in range(rng.choice([0, 1, 6])):
            for _ in range(rng.choice([1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) + rng.choice(["", line]))
    return list(enumerate(out))


@pytest.mark.parametrize("seed,few,keys", [(1, 2, 1 << 20), (2, 0, 1 << 20), (3, 10**9, 3)])
def test_stage_links_by_similarity(spark, sf, seed, few, keys, monkeypatch):
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "KEYS", keys)
    rows = texts(seed)
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = cp.near_duplicates(spark, docs, sf).select("doc_id").collect()
    want = brute(rows)
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < len(rows) - 20


def test_prefixes():
    for n in range(1, 400):
        need = -(-4 * n // 5)
        assert similar.prefix_length(n) == n - need + 1
    assert similar.alike(8, 9, 9) and not similar.alike(7, 9, 8) and similar.alike(4, 5, 4)


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n, change in ((1, 1), (40, 3), (700, 60), (5000, 400)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[change:], rng.integers(0, 1 << 63, change, dtype=np.uint64)]))
        x, y = (np.frombuffer(similar.parity(s), np.uint64) for s in (a, b))
        assert len(x) * 64 == similar.PARITY and np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert not np.bitwise_count(x ^ x).sum()


def near_copies(seed, n=150):
    """A large group of copies with a few words changed, some too far from each other, beside texts with a common line."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(4000)
    base = [word() for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    line = " ".join(word() for _ in range(12))
    return list(enumerate(out + [line + " " + word() + " " + word() for _ in range(n // 2)]))


def stage(spark, sf, rows):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    return sorted(r.doc_id for r in cp.near_duplicates(spark, docs, sf).select("doc_id").collect())


def test_stage_comes_through_simhash(spark, sf, monkeypatch):
    """The stage's sets meet under deletion-variant signatures of their fingerprints, and what is alike there is linked."""
    seen, given = [], []
    links, verified = simhash.links, similar._verified
    monkeypatch.setattr(simhash, "links", lambda fps, *how: (seen.append(([r.fp for r in fps.collect()], how)), links(fps, *how))[1])
    monkeypatch.setattr(similar, "_verified", lambda pairs, *rest: (given.append([(r.a, r.b) for r in pairs.collect()]), verified(pairs, *rest))[1])
    rows = near_copies(7, 40)
    assert stage(spark, sf, rows) == sorted(brute(rows)) and len(seen) == 1
    sets = similar._sets(pa.array([t.encode() for _, t in rows], pa.binary()), 5)
    fp = dict(zip([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], simhash.majority(sets).tolist(), strict=True))
    fps, (radius,) = seen[0]
    fps = {f % (1 << 64) for f in fps}
    assert radius == similar.RADIUS == 4 and fps <= set(fp.values()) and len(fps) >= 40
    near = [(fp[a % (1 << 64)], fp[b % (1 << 64)]) for a, b in given[0]]
    assert near and all((a ^ b).bit_count() <= radius for a, b in near)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= radius)


@pytest.mark.parametrize("few,most,shingles", [(64, 2048, 1 << 20), (4, 16, 1 << 20), (8, 2048, 2000)])
def test_large_groups_of_near_copies(spark, sf, few, most, shingles, monkeypatch):
    """One bucket holds a whole group: no list of all its pairs, no rounds of jobs, blocks against each other, the same result."""
    for name, value in (("FEW", few), ("MOST", most), ("SHINGLES", shingles)):
        monkeypatch.setattr(similar, name, value, raising=False)
    made, crossing = [], similar._crossing
    monkeypatch.setattr(similar, "_crossing", lambda rooted: (made.append((crossing(rooted).count(), rooted.count())), crossing(rooted))[1])
    rows = near_copies(11)
    assert stage(spark, sf, rows) == sorted(brute(rows))
    assert all(2 * pairs <= few * met for pairs, met in made)


def test_jobs_of_the_stage(spark, sf):
    """The driver keeps something of every job and task: a stage has a bounded number of rounds."""
    rows = near_copies(11)
    spark.sparkContext.setJobGroup("near_dedup", "near_dedup")
    stage(spark, sf, rows)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near_dedup"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 180


def test_jobs_of_a_sketch(spark):
    """The sketch comes to the driver in jobs by its size, not in one for each partition."""
    hashes = np.random.default_rng(5).integers(0, 1 << 64, 4000, dtype=np.uint64)
    hashes[3000:] = hashes[:1000]
    df = spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "h long").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("sketch", "sketch")
    try:
        bits, counts = sketch.merged(df, lambda batch: iter([batch.column("h").to_numpy().view(np.uint64)]), 1 << 23, 1, 20)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch")) <= 8
    cell, n = np.unique(sketch.cell(hashes, 0, 1 << 23), return_counts=True)
    want = np.zeros(1 << 23, bool)
    want[cell[n > 1]] = True
    assert (np.unpackbits(bits[0], bitorder="little") == want).all()
    assert (counts == np.bincount(sketch.coarse(hashes, 20), minlength=1 << 20)).all()


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_stars_by_tables_and_in_one_task(spark, few):
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    spark.sparkContext.setJobGroup(f"stars{few}", "stars")
    got = simhash.components(spark.createDataFrame(pairs, "a long, b long"), few).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"stars{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in linked)
    assert not few or jobs <= 12
    assert simhash.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_the_driver_hands_memory_back(spark):
    jvm = spark.sparkContext._jvm
    held = [jvm.java.util.ArrayList() for _ in range(2)]
    for x in held:
        x.ensureCapacity(40_000_000)
    full = jvm.java.lang.Runtime.getRuntime().totalMemory() - jvm.java.lang.Runtime.getRuntime().freeMemory()
    for x in held:
        x.trimToSize()
    shared.trimmed(spark)
    left = jvm.java.lang.Runtime.getRuntime().totalMemory() - jvm.java.lang.Runtime.getRuntime().freeMemory()
    assert left < full - 200e6


def test_forest():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[int(rng.integers(0, 9)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    odd = np.stack([np.frombuffer(similar.parity(s), np.uint64) for s in sets])
    root = np.arange(60) // 2 * 2  # pairs that are one component before
    a, b = similar.forest(np.arange(60), n, np.zeros(60, int), root, odd, sets)
    alike = lambda i, j: similar.alike(len(np.intersect1d(sets[i], sets[j])), n[i], n[j])

    def classes(edges):
        name = root.copy()
        for i, j in edges:
            name[name == name[i]] = name[j]
        return {frozenset(np.flatnonzero(name == r).tolist()) for r in set(name.tolist())}

    assert all(alike(i, j) for i, j in zip(a, b, strict=True)) and len(a) < 60
    assert classes(zip(a, b, strict=True)) == classes([(i, j) for i in range(60) for j in range(i) if alike(i, j)])
