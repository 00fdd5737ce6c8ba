import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import neighbours, packing

ROWS = "doc_id long, text string, lang string, key string"


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, rows, length=2048):
    ids = {d: reference_ids(t) for d, t in rows}
    docs, seqs = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        seqs.setdefault(p.sequence_id, []).append(p)
    assert set(docs) == set(ids)
    for d, ps in docs.items():
        ps.sort(key=lambda p: p.start)
        at = 0
        for p in ps:
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for ps in seqs.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_round_trip(spark):
    rng = random.Random(2)
    odd = ["", None, " ", "a  b", "a \nb", "x\n \ny", "end ", "it's 'll  1234 ü ñandú", "<|endoftext|> x", "日本語 text", "a  b", "tab\t here \t", " lead", "\n\n a"]
    rows = list(enumerate(odd + [" ".join(rng.choice(["the", "Häuser", "x1,", "don't", "\nnew"]) for _ in range(rng.choice([1, 50, 3000]))) for _ in range(40)]))
    df = spark.createDataFrame([(d, t, "en", "clash") for d, t in rows], ROWS).repartition(4)
    assert check_pieces(packing.pack(df).collect(), rows) == 0


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert check_pieces(packing.pack(df).collect(), rows) == 0


def test_pack_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], ROWS)).collect() == []
    got = packing.pack(spark.createDataFrame([(None, "x", "", ""), (None, "x", "", ""), (None, None, "", "")], ROWS)).collect()
    assert sorted(p.doc_tokens for p in got) == [1, 2, 2]


def test_pack_many_equal_rows_and_a_long_text(spark):
    """Equal rows don't share a stretch, stretches go by ids, and a text of megabytes comes back whole."""
    rows = [(1, "all the same words", "", "")] * 3000 + [(2, "some words of a very long text, " * 60_000 + "<|endoftext|>" + "z" * 5000, "", "")]
    got = packing.pack(spark.createDataFrame(rows, ROWS), stretch_ids=20_000).collect()
    assert len({p.sequence_id >> 40 for p in got if p.doc_id == 1}) > 4
    assert len([p for p in got if p.doc_id == 1 and p.start == 0]) == 3000
    whole = sorted((p for p in got if p.doc_id == 2), key=lambda p: p.start)
    ids = reference_ids(rows[-1][1])
    assert 50256 in ids and whole[0].doc_tokens == len(ids)
    for p in whole:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())


def test_hilbert_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute(ids, v, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            s = (v * v[i]).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("block", [16384, 100])
def test_recall(spark, sf, block):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64))
    got = {}
    for r in neighbours.search(df, block=block, queries_block=7 if block == 100 else 4096).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.97
    for q in want:
        exact = dict(want[q])
        assert all(abs(exact[a] - s) < 1e-12 for a, s in got[q] if a in exact)


def test_estimates_from_packed_bits():
    """Bits and planes give what the plain sum over dimensions gives, and errors keep to their bounds."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((3000, 20)) * rng.uniform(0.1, 9, (3000, 1))
    turn = neighbours.rotation(neighbours.width(20))[:20]
    way, length = neighbours.directions(v)
    turned = way @ turn
    agree = np.abs(turned).sum(1) / 16
    codes = neighbours.Codes(neighbours.packed(turned > 0), length, agree)
    q = rng.standard_normal(20)
    q /= np.linalg.norm(q)
    mine = q @ turn
    step = (mine.max() - mine.min()) / 15
    rounded = mine.min() + step * np.rint((mine - mine.min()) / step)
    plain = np.where(turned > 0, 1, -1) @ rounded / 16 / agree * length
    est, error = codes.estimate(mine)
    assert np.allclose(est, plain)
    off = np.abs(est - v @ q) / error
    assert (off < 2.5).mean() > 0.97 and off.mean() > 0.3


def test_clashing_columns_and_repeats(spark):
    rows = [(i, [float(i % 7), 1.0], 0.5, 3, "x") for i in range(50)] * 2
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, rank int, query_id string")).collect()
    assert len(got) == 3 * 20 and all(r.score == (r.query_id % 7) * (r.vec_id % 7) + 1.0 for r in got)


def test_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(30)] + [(40, [0.0, 0.0], 0), (60, None, 0), (80, [1.0, float("nan")], 0), (100, [1.0, None], 0), (None, [1.0, 1.0], 0), (120, [float("inf"), 1.0], 0), (140, [1.0], 0), (0, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 21)] + [(20, i) for i in range(20)]
    assert neighbours.search(df.where("vec_id < 3")).count() == 2
    assert neighbours.search(df.where(F.lit(False))).collect() == []


def test_both_libraries_give_the_same_ids():
    enc = packing.Encoder(packing.default_tokenizer())
    assert enc.fast is not None
    letters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not packing._OTHER.match(chr(c))]
    texts = [f"a{c}b {c} {c}{c}1 \n{c}'s{c}  {c}" for c in letters]
    rng = random.Random(5)
    pool = [c for c in letters if ord(c) < 0x500] + list(" \n\t' \u0085\x1c") * 40
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 300))) for _ in range(3000)]
    assert all(map(enc.alike, texts))
    want = [np.array(e.ids, enc.dtype).tobytes() for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    got = enc.encode(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
    assert not enc.alike("x" * 401) and not enc.alike(" " * 500) and not enc.alike("नमस्ते") and enc.alike("w " * 100_000)
