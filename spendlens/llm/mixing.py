"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 7, native).

Every source gets a target number of words: weights 5, 2, 1 repeat over the sources in code-point
order (null last), targets share ``share`` times all words and stop at ``limit`` times a source's
own words; what a full source leaves is shared again by weight.  Targets become whole blocks of
``block`` words in two apportionments by highest quotients ``v / (2 s + 1)``: all blocks over the
sources, then a source's blocks over its shards.  Neither lists the blocks: two divisors bracket
every party's seats, and only the few seats between them are decided by comparing quotients.  What whole blocks
leave of a source's target, or give beyond it, is settled in words over its shards in order, so each source
meets its rounded target, one of less than a block included.

A shard holds about ``shard_rows`` documents of one source, dealt by a seeded hash, so a source
with a third of all rows is many shards and one window never holds more than a shard.  Inside a
shard documents lie in seeded order; the shard's quota takes the first words of that order, going
round again after the last one (at most ``limit`` times).

Cases: a null or blank text has size 0 and takes nothing; a null source is a source; equal
doc_ids are ordered by size; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK = 32
SHARD_ROWS = 2000
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Per source its size, weight and target (one row per source, so the windows hold sources only).

    Sources stop at ``limit * size``; in order of size per weight the full ones come first, so a
    running sum over that order finds the water level without repeating the sharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    known = sizes.select("source", "source_size", pick.cast("double").alias("weight"))
    everything = Window.partitionBy()
    fullness = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fullness.rowsBetween(Window.unboundedPreceding, -1)
    most = F.col("source_size") * F.lit(float(limit))
    level = known.select(
        "*",
        F.row_number().over(fullness).alias("place"),
        most.alias("most"),
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum(most).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    ).withColumn("full", F.col("most") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    # the first source that is not full fixes the level for it and all after it
    first_open = F.min_by(F.col("left") / F.col("weight_left"), F.when(~F.col("full"), F.col("place")))
    level = level.withColumn("level", first_open.over(everything))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("level"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, value: str, seats: str, most: str, by: list[str], key: str, out: str) -> DataFrame:
    """Seats by highest quotients ``value / (2 s + 1)`` inside each ``by`` group, at most ``most`` each.

    ``seats`` is the group's number of seats, n its number of parties.  Rounding ``value / divisor``
    misses the total by at most n / 2, so the divisors for n seats less and 2 n seats more bracket the
    result: below the first a seat is certain, above the second none is given, and only the at most
    few n seats between them are ranked by quotient.  Equal quotients go by ``key``.  A limit below a
    party's rounded share is no seat lost for others only within the bracket; the callers' limits
    cut off less than a seat.
    """
    group = Window.partitionBy(*by)
    share = lambda number: F.floor(F.coalesce(F.col(value) * number / F.nullif(F.sum(value).over(group), F.lit(0)), F.lit(0.0)) + 0.5)
    n = F.count(F.lit(1)).over(group)
    known = parties.withColumns({
        "__low": F.least(F.col(most), F.greatest(F.lit(0), share(F.col(seats) - n))).cast("long"),
        "__high": F.least(F.col(most), share(F.col(seats) + 2 * n)).cast("long"),
    }).withColumn("__open", F.col(seats) - F.sum("__low").over(group))
    between = F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))
    ranked = known.withColumn("__seat", F.explode_outer(between)).withColumn("__quotient", F.col(value) / (2 * F.col("__seat") + 1))
    order = group.orderBy(F.col("__quotient").desc_nulls_last(), F.col(key).asc_nulls_last())
    won = ranked.withColumn("__won", (F.col("__seat").isNotNull() & (F.row_number().over(order) <= F.col("__open"))).cast("long"))
    carried = [F.first(c).alias(c) for c in parties.columns if c not in (*by, key)]
    return won.groupBy(*by, key).agg(*carried, (F.first("__low") + F.sum("__won")).alias(out))


def mix(
    docs: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = SEED,
    weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and ``keep``) for every row of ``docs``."""
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size"), *keep), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, limit).join(
        per_source.select(F.col("source").alias("__source"), "rows"), F.col("source").eqNullSafe(F.col("__source"))
    )
    targets = targets.drop("__source").withColumn("most", F.floor(F.col("source_size") * limit / block))
    targets = targets.withColumn("seats", F.sum(F.least("most", F.round(F.col("target") / block))).over(Window.partitionBy()).cast("long")).withColumn("__all", F.lit(0))
    quotas = sainte_lague(targets, "target", "seats", "most", ["__all"], "source", "quota").drop("__all", "seats", "most", "weight")
    rounded = F.least(F.round("target").cast("long"), F.col("source_size") * limit)
    quotas = quotas.withColumn("owed", rounded)

    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    dealt = sized.join(quotas.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    dealt = dealt.withColumn("__h", order).withColumn(
        "shard", F.pmod(F.shiftright("__h", 20), F.ceil(F.col("rows") / shard_rows))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("owed").alias("owed"))
    shards = shards.withColumn("most", F.floor(F.col("shard_size") * limit / block))
    shards = sainte_lague(shards, "shard_size", "quota", "most", ["source"], "shard", "shard_quota")
    whole = F.col("shard_quota") * block
    shards = shards.withColumn("rest", F.col("owed") - F.sum(whole).over(Window.partitionBy("source")))
    room = F.when(F.col("rest") > 0, F.col("shard_size") * limit - whole).otherwise(whole)  # words to add, or to take back
    before = F.coalesce(F.sum(room).over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.least(room, F.greatest(F.lit(0), F.abs("rest") - before)) * F.signum("rest").cast("long")
    shards = shards.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "shard_size", (whole + moved).alias("shard_words"))
    placed = dealt.join(shards, F.col("source").eqNullSafe(F.col("__source")) & (F.col("shard") == F.col("__shard")))
    seeded = Window.partitionBy("source", "shard").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__start", F.coalesce(F.sum("size").over(seeded), F.lit(0)))
    words = F.col("shard_words")
    rounds = [F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("shard_size") * r - F.col("__start"))) for r in range(limit)]
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", sum(rounds[1:], rounds[0]).cast("long").alias("taken"), *keep
    )
