import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import html, language, pages, toxicity

DATA = "/root/testdata/sf0.1"


def rank_quality(y, s):
    y, s = np.array(y), np.array(s)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = toxicity.predictions(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    y, s = [r.toxic for r in got], [r.score for r in got]
    quality, right = rank_quality(y, s), np.mean([r.toxic == r.predicted for r in got])
    print("toxicity", len(got), quality, right)
    assert quality > 0.93 and right > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def plain_distances(model, text):
    """Windows, chains and compression spelled out."""
    import zstandard

    def chain(word):
        w = "".join(chr(c) for c in word)
        while w and toxicity._EDGE[ord(w[0])]:
            w = w[1:]
        while w and toxicity._EDGE[ord(w[-1])]:
            w = w[:-1]
        h, out = 0, []
        for c in w:
            c = ord(c) + 32 if "A" <= c <= "Z" else ord(c)
            h = (h * toxicity._ODD + int(toxicity._VALUE[c])) % 2**64
            x = h ^ h >> 30
            x = x * 0xBF58476D1CE4E5B9 % 2**64
            x ^= x >> 27
            x = x * 0x94D049BB133111EB % 2**64
            out.append(int(toxicity._CODE[((x ^ x >> 31) >> 33) % len(toxicity._CODE)]))
        return bytes(out)

    def length(content, data):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=256, dict_size=len(content), write_content_size=0, write_dict_id=0, write_checksum=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        held.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(data))

    words = [c for c in map(chain, text.split()) if c]
    both = model.ordinary, model.toxic + model.ordinary
    bare = [length(d, model.ballast) for d in both]
    for i in range(0, len(words), model.window):
        w = b" " + b" ".join(words[i : i + model.window]) + b" " + model.ballast
        a, b = (length(d, w) - n for d, n in zip(both, bare, strict=True))
        yield a - b


def test_toxicity_brute_and_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (2, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.predictions(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0}
    assert toxicity.predictions(docs.where(F.lit(False)), labels).collect() == []
    rng = np.random.default_rng(2)
    common = ["".join(rng.choice(list("etaoinshr"), 7)) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(common, n))
    bad = [f"{say(30)} idiotic {say(12)} clownish {say(5)}".encode() for _ in range(60)]
    model = toxicity.train(bad, [say(60).encode() for _ in range(120)])
    assert model.toxic and model.cut in (2, 3, 4)
    texts = [b"", b" ... !", f"{say(100)} (Idiotic!) {say(4)}".encode(), say(50).encode(), "Über\u00e9 \u4f60 idiotic\tclownish".encode(), b"idiotic"]
    import pyarrow as pa

    own = toxicity.Scorer(model)
    held = toxicity.chains(texts)
    for i, t in enumerate(texts):
        assert own.distances(held, i) == list(plain_distances(model, t))
    many = f"{say(40_000)} idiotic clownish {say(9)}".encode()
    scores = own.scores(pa.array([*texts, many], pa.binary()))
    for t, s in zip([*texts, many], scores, strict=True):
        total = sum(d for d in plain_distances(model, t) if d >= model.cut) / max(1, len(t)) ** model.power if len(t) < 1000 else None
        assert total is None or s == pytest.approx(total / (total + model.threshold))
    assert scores[2] >= 0.5 > scores[3] and scores[0] == scores[1] == 0 < scores[-1]
    table = spark.createDataFrame([(i, t.decode(), "x", 2.0) for i, t in enumerate(texts)], "doc_id long, text string, source string, score double")
    got = toxicity.scored(table, model).orderBy("doc_id")
    assert got.columns == ["doc_id", "text", "source", "score"] and [r.score for r in got.collect()] == pytest.approx(list(scores[:-1]))


def test_toxicity_draws_agree(spark):
    """Repeated ids with different texts: the rows learned from don't depend on the partitioning."""
    rows = [(i % 40, f"some text number {i} of all with a {'clownish fool' if i % 3 == 0 else 'nice person'} in it") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    one, two = (toxicity.fit(docs.repartition(n), labels, toxic_rows=30, ordinary_rows=40) for n in (2, 7))
    assert one == two


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = np.mean([r.lang == r.lang_pred for r in got])
    print("language", len(got), right)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in got} == {2}


def test_language_mixture_and_edges(spark):
    en, de = "the cat and the dog went to the house with them ", "der hund und die katze gingen in das haus mit ihnen "
    model = language.train([("en", en * 50), ("de", de * 50)])
    chosen, parts = model.mixture(language.letters(en * 30 + de * 10))
    assert [model.languages[i] for i in chosen] == ["en", "de"] and 0.65 < parts[0] < 0.85
    assert len(model.mixture(language.letters(en * 10))[0]) == 1
    assert [model.predict(t)[0] for t in (None, "", "12 ?! ²", "The Cat")] == ["und", "und", "und", "en"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.predictions(empty).collect() == []
    docs = spark.createDataFrame([(1, en, None), (2, None, "en"), (None, "x", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predictions(docs).collect()} == {"und"}


def brute_mixture(model, text, penalty=2.0, rounds=25):
    """EM and the set search with plain loops, an n-gram at a time."""
    import math
    import re

    line = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    if not any(c.isalpha() for c in line):
        return []
    line = f" {line} "
    grams = [int(language.ngrams(line[i : i + 3])[0]) for i in range(len(line) - 2)]

    def em(langs, share):
        for _ in range(rounds):
            new = [0.0] * len(langs)
            for g in grams:
                odds = [s * model.table[g][k] for s, k in zip(share, langs, strict=True)]
                for i, x in enumerate(odds):
                    new[i] += x / sum(odds) / len(grams)
            moved, share = max(abs(x - y) for x, y in zip(new, share, strict=True)), new
            if moved < 1e-4:
                break
        return share

    every = list(range(len(model.languages)))
    share = em(every, [1 / len(every)] * len(every))
    order = sorted(every, key=lambda k: (-share[k], k))
    best, found = -math.inf, []
    for k in range(1, len(order) + 1):
        some = order[:k]
        total = sum(share[i] for i in some)
        own = em(some, [share[i] / total for i in some]) if k > 1 else [1.0]
        value = sum(math.log(sum(s * model.table[g][i] for s, i in zip(own, some, strict=True))) for g in grams) - penalty * (k - 1) * math.log(len(grams))
        if value <= best:
            break
        best, found = value, sorted(zip(own, some, strict=True), key=lambda x: (-x[0], x[1]))
    return [(model.languages[i], s) for s, i in found]


def test_language_brute():
    rng = np.random.default_rng(6)
    words = {k: ["".join(rng.choice(list(letters), 5)) for _ in range(40)] for k, letters in {"aa": "abcde", "bb": "cdefg", "cc": "hijkl", "dd": "mnopq", "ee": "rstuv", "ff": "wxyz", "gg": "abhimn", "hh": "pquvw"}.items()}
    model = language.train([(k, " ".join(rng.choice(w, 300))) for k, w in words.items()])
    texts = ["abc", "x", "a b"]
    for n in (1, 2, 3, 8):
        some = rng.choice(list(words), n, replace=False)
        texts.append(" ".join(" ".join(rng.choice(words[k], 30 + 10 * i)) for i, k in enumerate(some)))
    for t in texts:
        got, want = model.languages_of(t), brute_mixture(model, t)
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert len(model.languages_of(texts[-1])) == 8  # more than a few languages are all found


def test_language_rows(spark):
    """Ids that repeat or are null, clashing columns, ties, and a very long text."""
    en, de = "the cat and the dog went to the house with them", "der hund und die katze gingen in das haus mit ihnen"
    own = next(i for i in range(20, 40) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(None, en, "en", 1.0, "x")] * 30 + [(own, de, "de", 1.0, "x")] * 30 + [(9, (en + " ") * 40_000, None, 1.0, "x"), (10, "\u4f60\u597d", None, None, None)]
    got = language.predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string"), language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string"))).collect()
    assert len(got) == 62 and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score", "languages"}
    assert all(r.lang_pred == r.lang for r in got if r.lang) and {r.lang_pred for r in got if r.doc_id == 9} == {"en"}
    assert all(abs(sum(x.share for x in r.languages) - 1) < 1e-6 for r in got)
    assert {r.lang_pred for r in got if r.doc_id == 10} <= {"de", "en"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x("<p>bad</p>")</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, a very long notice about cookies and more cookies for you.</div>
<article><h1>Title &amp; more</h1><p><b>First  <i>para</i>graph
with &lt;words&gt;<br>and a line of many other words to read.<p>Second&nbsp;one, with enough of its own words to count.</p><div class="ad">Buy now, cheap cheap cheap</div>
<p>Third one: 1 &lt; 2 in every year that we know of, and so on.</p><section id="comments"><p>Nice article, dear writer, thank you very much for this!</p></section></article>
<form>Name <input> and a word or two</form><footer>&copy; us</footer></body></html>"""


def test_html():
    want = "Title & more First paragraph with <words> and a line of many other words to read. Second one, with enough of its own words to count. Third one: 1 < 2 in every year that we know of, and so on."
    assert html.extract(PAGE) == want
    assert html.extract(None) == html.extract("") == html.extract("<p></p>") == html.extract("<script>x") == ""
    assert html.extract("<p>a < b and c</p>") == "a < b and c"
    assert html.extract("<p>" + "word " * 100_000 + "</p>").count("word") == 100_000


def test_html_best_run_brute():
    rng = np.random.default_rng(4)
    for _ in range(60):
        row = [["open", str(rng.choice(["p", "a", "li", "td"])), "", -1] if rng.random() < 0.6 else ["text", "w " * int(rng.integers(1, 4)), "", -1] for _ in range(40)]
        value = html._WEIGHTS.of(row)
        assert all((v > 0) == (t[0] == "text") for v, t in zip(value, row, strict=True))
        a, b = html.region(row, [False] * 40)
        assert sum(value[a:b]) == pytest.approx(max(sum(value[i:j]) for i in range(40) for j in range(i, 41)))


def test_html_held_out_designs():
    """Pages with other words and layouts than those learned from."""
    import re
    from html import unescape

    small = "b|i|em|strong|a|span|small"
    exact = 0
    for before, part, after in pages.labelled(120, seed=9):
        want = " ".join(unescape(re.sub(rf"</?(?:{small})\b[^>]*>", "", re.sub(rf"</?(?!(?:{small})\b)\w+\b[^>]*>", " ", part))).split())
        exact += html.extract(before + part + after) == want
    print("html", exact)
    assert exact >= 114


LONG = "<p>" + "word and more of it to read here " * 20 + "</p>"


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">%s</div>', '<div id="page" class="no-header">%s</div>', '<div class="article-meta-wrap meta">%s</div>', "<form id=f>%s</form>", '<div class="sidebar-layout"><article>%s</article><div class="sidebar">a b c d e f</div></div>', "<main class=menu>%s</main>"])
def test_html_wrappers_stay(wrap):
    page = "<body><div class=nav><a href=/>Home</a></div>" + wrap % LONG + "<div class='footer'>all rights of us</div><div id=comments><article class=comment><p>so nice</p></article></div></body>"
    assert html.extract(page) == " ".join(("word and more of it to read here " * 20).split())


@pytest.mark.parametrize("part", ["<a ", "<title>", '<a "x>" ', "<", "<!--", "<b>", "<p 'x", "</p>", "<div class='nav'>", "<form><p>a ", "<script>", "&amp;"])
def test_html_time_is_linear(part):
    import time

    def took(n):
        t = time.process_time()
        html.extract(part * n)
        return time.process_time() - t

    assert took(80_000) < 12 * took(20_000) + 0.5


def test_html_rows(spark):
    """Null and empty pages, repeated rows, an empty table, columns with clashing names."""
    shape = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", LONG, "x", 3), (1, "u", LONG, "x", 3), (None, None, None, None, None), (2, "v", "", "x", 3), (3, None, "<p>a &lt; b</p>", "x", 3)]
    got = html.digest(spark.createDataFrame(rows, shape)).collect()
    want = html.extract(LONG)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", want, len(want)), (1, "u", want, len(want)), (None, None, "", 0), (2, "v", "", 0), (3, None, "a < b", 5)], key=str)
    assert html.digest(spark.createDataFrame([], shape)).collect() == []


def test_html_pages(spark, sf):
    import re
    from html import unescape

    table = spark.read.parquet(f"{sf}/pages.parquet")
    for r in html.digest(table).join(table.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"</?(b|i|em|strong|a|span)\b[^>]*>", "", re.sub(r"</?(p|h1|br|li|ul|div)\b[^>]*>", " ", body))).split())
        assert r.text == want and r.n_chars == len(want)
