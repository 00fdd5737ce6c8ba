import random
from collections import Counter

import corpus_pipeline as cp
import pytest

from gridloom.llm import mixing, toxicity
from gridloom.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import brute_groups, brute_repeats
from .test_packing_neighbours import check_pieces

CLASH = ["kept", "n_words", "n_removed", "score", "fp", "size", "draw", "rounds", "taken", "key", "tie", "source_size", "target", "stretch", "component_id"]
ROWS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["clash"] * len(CLASH)) for i, t, s in rows], ROWS)


def some_rows(seed=4):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(900)
    passage = [word() for _ in range(60)]
    out = []
    for i in range(160):
        w = [word() for _ in range(rng.choice([0, 1, 5, 40, 300]))]
        if i % 6 == 0:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 4 == 0 and out:
            w = (out[rng.randrange(len(out))][1] or "").split()  # a copy of one before
        out.append((i, " ".join(w), rng.choice(["a", "a", "b", "c", None])))
    return out + [(900, None, "a"), (None, "no id here", "b"), (901, None, None), (902, "\n", "c"), (903, "long " * 40_000, "b"), (903, "long " * 40_000, "b")]


def test_stages(spark, sf):
    rows = some_rows()
    docs = docs_of(spark, rows)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    names = docs.columns
    clean = cp.toxic(spark, docs, sf)
    assert clean.columns == names
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    own = toxicity.Scorer(model)
    want = Counter((i, t) for i, t, _ in rows if own.score((t or "").encode()) < 0.5)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == want and len(want) > 100

    single = cp.near_duplicates(spark, docs, sf)
    assert single.columns == names
    kept = single.select("doc_id", "text").collect()
    with_id = [(i, t) for i, t, _ in rows if i is not None]
    fp_of = {i: f for i, f, _ in brute_groups(with_id)}
    groups = {c for i, _, c in brute_groups(list(dict(with_id).items()))}
    assert {r.doc_id for r in kept} - {None} == groups and len(kept) == len({r.doc_id for r in kept}) and fp_of

    cut = cp.repeated_passages(spark, docs, sf)
    assert cut.columns == names
    got = Counter((r.doc_id, len((r.text or "").split()), r.n_chars) for r in cut.collect())
    texts = {}
    for r in cut.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for (i, t, _), (_, n, gone, _) in zip(rows, brute_repeats([(i, t) for i, t, _ in rows])):
        mine = texts[i][0]
        assert len((mine or "").split()) == n - gone and (gone or mine == t)
    assert sum(got.values()) == len(rows) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut.collect())

    mixed = cp.mix(spark, docs, sf)
    assert mixed.columns == names
    took = {}
    for r in mixing.mix(docs).collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    have = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + len(r.text.split())
    assert have == {k: v for k, v in took.items() if v}

    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = cp.pack(spark, unique, sf).collect()
    assert check_pieces(pieces, [(r.doc_id, r.text) for r in unique.select("doc_id", "text").collect()]) == 0


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_empty_tables(spark, sf, name, stage):
    empty = docs_of(spark, [])
    assert stage(spark, empty, sf).collect() == []


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    tokens = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    total = lambda c: sum(k[2] * n for k, n in c.items())
    got, want = tokens(cp.run(spark, sf)), tokens(cp.pack(spark, docs, sf))
    assert total(got) == total(want) > 0 and {k[0] for k in got} == {k[0] for k in want}


def test_queries_run(spark, sf):
    assert set(ORACLE_SQL) < set(QUERIES) and len(QUERIES) == 10
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_media", "op3_mixing", "op4_toxicity", "op6_language", "op8_substrings", "op10_simhash"):
        assert QUERIES[name](spark, sf).count() == n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLE_SQL[name]).df()
    key = sorted(got.columns)
    assert sorted(map(str, got[key].fillna("-").itertuples(index=False, name=None))) == sorted(map(str, want[key].fillna("-").itertuples(index=False, name=None)))
