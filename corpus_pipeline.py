"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, repeated
passages go, sources are mixed to target weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and reads whole what the stage before it kept. All but the last return the
columns of `documents`; n_chars follows the text where a stage changes it. Each begins by collecting the driver's garbage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import mixing, packing, similar, substrings, toxicity
from gridloom.llm.common import table
from gridloom.shared import stored, trimmed


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns`, with n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.5."""
    trimmed(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, into="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of those alike to 0.8 or more in five-word shingles."""
    trimmed(spark)
    return similar.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the words of windows that also start elsewhere; texts without any stay as they are."""
    trimmed(spark)
    own = substrings.repeated(docs)
    return _with_text(own.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: whole documents as often as it takes them, and runs of words of others."""
    trimmed(spark)
    return _with_text(mixing.mixed(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the curve together."""
    trimmed(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("mixing", mix), ("packing", pack)]

#: Compression distances, XXH64 and a tokenizer have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
