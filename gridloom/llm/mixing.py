"""Mixing sources to target weights, by highest quotients (Sainte-Lague), in DataFrame operations only.

1. Each document's size is its number of words; each source's size is their sum.
2. Targets: all sources share the words of all documents by weight; a target stops at `repeat` times its source's
   size, and the excess is shared again by weight. That is one level for which min(repeat * size, level * weight)
   sums to the whole; it is read off the sources sorted by size over weight.
3. Quotas: blocks of `block` words each go to the highest quotients target / (2k + 1). Of a source with a share s
   of the whole among n sources, the quota differs from its exact one by at most s * n / 2 + 1/2 blocks, so only
   that many candidates a source, 2n + 2 per step in all, are ranked, whatever the number of blocks.
4. Each source is cut into shards of about `shard_words` words by a seeded hash of the document; a source's quota is
   divided among its shards by the same quotients.
5. In a shard, documents stand in a seeded order as one row of words. The quota takes the row whole as often as it
   can, then a run of blocks from a seeded start, round the end. A shard never gives more than `repeat` times itself.

Groups of any size are sums first; the only windows run over one shard, over the shards of one source (words /
`shard_words` rows), and over the sources.

Defined cases: a null text counts as 0 words, takes 0 and stays in the result; a null source is a source of its own,
after all others; repeated rows count each and are told apart by nothing but their place among equals, which
changes no total; an empty table gives an empty result. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def words_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, repeat: int = 3) -> DataFrame:
    """From (source, source_size) to those and target. One row a source."""
    ranked = sources.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * repeat
    by_ratio = Window.orderBy(cap / F.col("__weight"), "__rank")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.withColumn("__level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("__weight").over(after))
    # the level of the first source, by ratio, that it leaves under its cap
    open_level = F.min(F.when(F.col("__level") * F.col("__weight") <= cap, F.struct(cap / F.col("__weight"), F.col("__rank"), F.col("__level").alias("level")))).over(every)["level"]
    return leveled.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap.cast("double"), F.coalesce(open_level * F.col("__weight"), cap.cast("double")))).alias("target"))


def apportion(parts: DataFrame, seats: Column, votes: str, key: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Adds `quota`: `seats` whole seats among the rows of a group `within`, by the highest votes / (2k + 1).

    Ties go by `key`. The candidates ranked are those within the bound that the module's text gives.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    known = parts.withColumns({"__all": F.sum(votes).over(group), "__n": F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(group), "__seats": seats})
    share = F.when(F.col("__all") > 0, F.col(votes) / F.col("__all")).otherwise(0.0)
    room = share * F.col("__n") / 2 + 1.0
    known = known.withColumn("__sure", F.when(F.col(votes) > 0, F.greatest(F.floor(share * F.col("__seats") - room), F.lit(0))).otherwise(0).cast("long"))
    known = known.withColumns({"__most": F.when(F.col(votes) > 0, F.ceil(share * F.col("__seats") + room)).otherwise(0).cast("long"), "__given": F.sum("__sure").over(group)})
    seat = known.where(F.col("__most") > F.col("__sure")).select(*within, *key, votes, "__seats", "__given", F.explode(F.sequence("__sure", F.col("__most") - 1)).alias("__k"))
    order = [(F.col(votes) / (2 * F.col("__k") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("__k")]
    won = seat.withColumn("__place", F.row_number().over(group.orderBy(*order))).where(F.col("__place") <= F.col("__seats") - F.col("__given"))
    names = [*within, *key]
    more = won.groupBy(*names).agg(F.count(F.lit(1)).alias("__won")).select(*[F.col(x).alias(f"__r_{x}") for x in names], "__won")
    same = [F.col(x).eqNullSafe(F.col(f"__r_{x}")) for x in names]
    joined = known.join(more, same, "left")
    return joined.select(*parts.columns, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("quota"))


def allotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, repeat: int = 3, block: int = 8, shard_words: int = 1 << 18, seed: int = 17) -> DataFrame:
    """doc_id, draw, size, source_size, target, and what the mix takes of each row: `rounds` times the whole, words
    from a1 up to b1, and words from a2 up to b2."""
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"), draw_of(id_col, text_col, source_col, seed).alias("draw"))
    sized = stored(sized)  # the texts are read once
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumn("__blocks", F.round(F.sum("source_size").over(whole) / block).cast("long"))
    sources = apportion(sources, F.col("__blocks"), "target", ["source"], [])
    sources = stored(sources.select("source", "source_size", "target", F.col("quota").alias("__quota"), F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long").alias("__shards")))
    to = sources.select(F.col("source").alias("__source"), "source_size", "target", "__quota", "__shards")
    placed = sized.join(to, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source").withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("draw")), F.col("__shards")))
    shards = placed.groupBy("source", "__shard").agg(F.sum("size").alias("__length"), F.max("__quota").alias("__quota"))
    quotas = apportion(shards, F.col("__quota"), "__length", ["__shard"], ["source"])
    quotas = quotas.select(F.col("source").alias("__source"), F.col("__shard").alias("__of"), "__length", F.least(F.col("quota") * block, F.col("__length") * repeat).alias("__words"))
    laid = placed.join(quotas, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__shard") == F.col("__of")), "left")
    rows = Window.partitionBy("source", "__shard").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumns({"__end": F.sum("size").over(rows), "rounds": F.when(F.col("__length") > 0, F.floor(F.col("__words") / F.col("__length"))).otherwise(0), "__rest": F.when(F.col("__length") > 0, F.col("__words") % F.col("__length")).otherwise(0)})
    start = F.floor(F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("__shard")), F.greatest(F.col("__length"), F.lit(1))) / block) * block
    laid = laid.withColumns({"__from": start, "__to": start + F.col("__rest"), "__at": F.col("__end") - F.col("size")})
    inside = lambda x: F.greatest(F.least(x - F.col("__at"), F.col("size")), F.lit(0)).cast("long")
    return laid.select(
        "doc_id", "draw", "size", "source_size", "target", F.col("rounds").cast("long").alias("rounds"),
        inside(F.col("__from")).alias("a1"), inside(F.col("__to")).alias("b1"), F.lit(0).cast("long").alias("a2"), inside(F.col("__to") - F.col("__length")).alias("b2"),
    )


def draw_of(id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source_size, target, taken. `taken`: words that the mix takes, repeats counted."""
    taken = F.col("rounds") * F.col("size") + F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2")
    return allotted(df, id_col, text_col, source_col, **how).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mix itself, with the columns of `df`: a row for each time that a whole text is taken, and one for each run
    of its words (joined by one space) that is. Rows of which nothing is taken go."""
    key = draw_of(id_col, text_col, source_col, seed)
    nth = lambda a, b: F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1)))
    plan = allotted(df, id_col, text_col, source_col, seed=seed, **how)
    plan = plan.select(F.col("doc_id").alias("__p_id"), F.col("draw").alias("__p_draw"), "size", "rounds", "a1", "b1", "a2", "b2")
    plan = plan.where("size > 0 and (rounds > 0 or b1 > a1 or b2 > a2)").withColumn("__p_nth", nth("__p_id", "__p_draw"))
    plan = plan.select("__p_id", "__p_draw", "__p_nth", *[F.col(c).alias(f"__{c}") for c in ("size", "rounds", "a1", "b1", "a2", "b2")])
    rows = df.withColumn("__draw", key).withColumn("__nth", nth(id_col, "__draw"))
    both = rows.join(plan, F.col(id_col).eqNullSafe(F.col("__p_id")) & (F.col("__draw") == F.col("__p_draw")) & (F.col("__nth") == F.col("__p_nth")))
    text = F.col(text_col)

    def run(a: str, b: str) -> Column:
        some = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), " ")
        return F.when(F.col(b) - F.col(a) == F.col("__size"), text).when(F.col(b) > F.col(a), some)

    pieces = F.concat(F.array_repeat(text, F.col("__rounds").cast("int")), F.filter(F.array(run("__a1", "__b1"), run("__a2", "__b2")), lambda x: x.isNotNull()))
    return both.withColumn("__piece", F.explode(pieces)).select(*[F.col("__piece").alias(c) if c == text_col else F.col(c) for c in df.columns])
