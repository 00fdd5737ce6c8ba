"""The queries of this subpackage, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html, language, media, mixing, neighbours, packing, simhash, substrings, toxicity, urls
from .common import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.digest(table(spark, sf_dir, "pages"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media, op2_url_filters, op3_mixing, op4_toxicity, op5_neighbours, op6_language, op7_html, op8_substrings, op9_packing, op10_simhash)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(('.' || host) LIKE '%.{0}' AND starts_with(path, '{1}'))"


def _url_sql() -> str:
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for _, h, p in ranked) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in ranked)
    globbed = " OR ".join(f"contains(host || path, '{g.strip('*')}')" for g in urls.GLOBS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0, 's')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut),
ruled AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, {rule} AS rule FROM parts)
SELECT page_id, host, path, rule, {verdict} ELSE CASE WHEN {globbed} THEN 'block' ELSE 'allow' END END AS verdict FROM ruled"""


#: Windows of 35 words as lists of word numbers, grouped; a word goes if one of the 35 windows that can hold it is repeated.
_SUBSTRING_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM texts WHERE len(w) >= 35),
hashed AS (SELECT r, i, hash(word)::HUGEINT AS a, hash(word || '#')::HUGEINT AS b FROM words),
known AS (SELECT r, i, md5(string_agg(a::VARCHAR || ' ' || b::VARCHAR, ',') OVER win) AS k, count(*) OVER win AS n FROM hashed WINDOW win AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
again AS (SELECT k FROM known WHERE n = 35 GROUP BY k HAVING count(*) > 1),
marked AS (SELECT r, i, CASE WHEN n = 35 AND k IN (SELECT k FROM again) THEN 1 ELSE 0 END AS s FROM known),
gone AS (SELECT r, i, max(s) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS g FROM marked),
per AS (SELECT r, sum(g)::BIGINT AS n_removed, list(i ORDER BY i) FILTER (g = 0) AS left_i FROM gone GROUP BY r)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(p.n_removed, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN p.r IS NULL OR p.n_removed = 0 THEN array_to_string(t.w, ' ') ELSE coalesce(array_to_string(list_transform(p.left_i, lambda i: t.w[i + 1]), ' '), '') END) AS kept_sha256
FROM texts t LEFT JOIN per p ON t.r = p.r"""

ORACLE_SQL: dict[str, str] = {"op2_url_filters": _url_sql(), "op8_substrings": _SUBSTRING_SQL}
