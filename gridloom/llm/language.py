"""Language ID as a mixture: expectation-maximisation over languages' n-gram models, a language set by penalty.

A text's letters, lower-cased, stand in words parted by one space; its n-grams are the runs of three of these
characters. Each language's model gives a smoothed probability to each of 2**16 hashed n-grams. For a text, EM finds
the languages' proportions that make its n-grams likeliest; languages are then taken in the order of their
proportions, one more each time, while the refitted likelihood gains more than `penalty` * log(n) a language. The result
is the set with its proportions; the prediction is the largest of the set, the score its proportion.

Fitting uses at most `rows` documents of each language, drawn by a hash of id and text; prediction reads whole texts. The
model takes 512 KB a language, and the languages are those of the table: what is learned from is one bounded table.
Defined cases: a null text or one without a letter is `und` with score 0 and no languages, and so is every text when nothing
was learned; ties go to the language that is first by name; null languages are not learned from; rows with one id or none
are drawn and predicted each; a text takes some 50 bytes a character while it is read, and its n-grams are counted
first, so that the mixture's cost has a bound; columns named as results are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, fold, steps, utf8

SIZE = 1 << 16
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased words of letters, each between spaces; empty without a letter."""
    line = _OTHER.sub(" ", text.lower())
    return f" {line.strip()} " if any(map(str.isalpha, line)) else ""


def ngrams(line: str) -> np.ndarray:
    c = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    return ((h * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)).astype(np.int64)


def counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells and how often each stands there."""
    if len(cells) < SIZE:
        return np.unique(cells, return_counts=True)
    times = np.bincount(cells, minlength=SIZE)
    some = np.flatnonzero(times)
    return some, times[some]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: A column a language: the probability of each hashed n-gram.
    table: np.ndarray

    def mixture(self, line: str, penalty: float = 2.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
        """The chosen languages' numbers and their proportions, largest first."""
        cells, times = counted(ngrams(line))
        p, n = self.table[cells], int(times.sum())
        share = self._shares(p, times, np.full(p.shape[1], 1 / p.shape[1]), rounds)
        order = np.argsort(-share, kind="stable")
        best, chosen, parts = -np.inf, order[:1], np.ones(1)
        for k in range(1, len(order) + 1):
            some = order[:k]
            start = share[some] / share[some].sum() if share[some[-1]] > 0 else np.full(k, 1 / k)
            own = self._shares(p[:, some], times, start, rounds) if k > 1 else np.ones(1)
            value = float(times @ np.log(p[:, some] @ own)) - penalty * (k - 1) * np.log(max(n, 1))
            if value <= best:
                break
            best, chosen, parts = value, some, own
        back = np.lexsort((chosen, -parts))
        return chosen[back], parts[back]

    @staticmethod
    def _shares(p: np.ndarray, times: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
        n = max(1, times.sum())
        for _ in range(rounds):
            new = share * ((times / (p @ share)) @ p) / n
            if np.abs(new - share).max() < 1e-4:
                return new
            share = new
        return share

    def languages_of(self, text: str | None) -> list[tuple[str, float]]:
        """The chosen languages with their proportions, largest first; none for a text without a letter."""
        line = letters(text) if text else ""
        if not line or not self.languages:
            return []
        chosen, parts = self.mixture(line)
        return [(self.languages[i], float(min(1.0, x))) for i, x in zip(chosen, parts, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.languages_of(text)
        return found[0] if found else (UNKNOWN, 0.0)


def train(rows: list[tuple[str, str]], smooth: float = 0.05) -> Model:
    """From (language, text)."""
    names = sorted({lang for lang, _ in rows})
    counts = np.zeros((SIZE, len(names)))
    for lang, text in rows:
        g = ngrams(letters(text or ""))
        counts[:, names.index(lang)] += np.bincount(g, minlength=SIZE)
    counts += smooth
    return Model(names, counts / counts.sum(0)) if names else Model([], counts)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, rows: int = 1000) -> Model:
    own = docs.where((fold(id_col, folds) != held_fold) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    at = F.xxhash64(F.lit("draw"), id_col, text_col)
    lang = F.col(lang_col).cast("string")
    counts = own.groupBy(lang.alias("__lang")).agg(F.count(F.lit(1)).alias("__of"))
    # of each language about `rows` are drawn before texts are moved; the rest of the bound is exact
    some = own.select(lang.alias("__lang"), F.col(text_col).cast("string").alias("__t"), at.alias("__at")).join(counts, "__lang")
    some = some.where(F.pmod("__at", F.lit(1 << 20)) <= 1.3 * (rows + 50) / F.col("__of") * (1 << 20))
    place = F.row_number().over(Window.partitionBy("__lang").orderBy("__at", "__t"))
    return train([(r[0], r[1]) for r in some.withColumn("__n", place).where(F.col("__n") <= rows).select("__lang", "__t").collect()])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and languages (the set with its proportions); columns with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 512 KB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "__text", 1 << 22):
            sets = [shared.value.languages_of(t.decode("utf-8", "replace")) for t in part.column("__text").to_pylist()]
            got = [x[0] if x else (UNKNOWN, 0.0) for x in sets]
            out = {k: c for k, c in zip(part.schema.names, part.columns, strict=True) if k != "__text"}
            out |= {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
            out["languages"] = pa.array([[{"lang": k, "share": v} for k, v in x] for x in sets], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kept = bounded(docs).drop("lang_pred", "score", "languages")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return kept.withColumn("__text", utf8(text_col)).mapInArrow(run, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = predicted(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "languages")
