"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasm.session import checkpoint

#: Length of the blocks in which an entity's intervals are merged on their own. A block has at most this many distinct starts.
BLOCK = 16_000 * 600


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """One row `(key, kind, from_sample, to_sample)` for each longest period of an entity and each gap between two of them.

    Overlapping and touching intervals (end = next start) form one period. Intervals with a null bound, or with start >= end,
    do not count. A null key is an entity of its own; repeated rows change nothing; other columns are ignored; an empty table
    gives no rows.

    Each entity is cut into blocks of `block` units by the starts, so that no task has to hold one entity. Within a block
    session_window with a duration per row merges overlaps (partially before the shuffle). What crosses blocks is settled on a
    table of one row per block: a running maximum of the ends carries periods into later blocks.
    """
    cols = df.select(F.col(key).alias("k"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    cols = cols.where("s < e").withColumn("b", F.floor(F.col("s") / F.lit(block)))
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(cast(e - s as decimal(20, 0)) / 1000000 as decimal(18, 6)))")
    merged = cols.groupBy("k", "b", F.session_window(F.timestamp_micros("s"), length).alias("w")).agg(F.count("*").alias("n"))
    # written once: the table is read once, and what follows uses the merged pieces twice
    pieces = checkpoint(merged.select("k", "b", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e")))

    def last(*by: str) -> Window:
        return Window.partitionBy(*by)

    blocks = pieces.groupBy("k", "b").agg(F.max("e").alias("e"))
    before = last("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("k", "b", F.max("e").over(before).alias("carry"), F.max("e").over(last("k")).alias("total"))
    heads = (
        join_keys(pieces.withColumn("lag", F.max("e").over(last("k", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))), blocks)
        .withColumn("prev", F.greatest("carry", "lag"))
        .where("prev is null or s > prev")
        .select("k", "b", "s", "prev", "total")
    )
    firsts = heads.groupBy("k", "b").agg(F.min_by("prev", "s").alias("first_prev"))
    firsts = firsts.select("k", "b", F.lead("first_prev").over(last("k").orderBy("b")).alias("later"))
    ended = join_keys(heads.withColumn("next", F.lead("prev").over(last("k", "b").orderBy("s"))), firsts)
    row = lambda kind, a, z: F.struct(F.lit(kind).alias("kind"), a.alias("from_sample"), z.alias("to_sample"))
    period = row("period", F.col("s"), F.coalesce("next", "later", "total"))
    gap = row("gap", F.col("prev"), F.col("s"))
    both = F.when(F.col("prev").isNull(), F.array(period)).otherwise(F.array(gap, period))
    return ended.select(F.col("k").alias(key), F.inline(both))


def join_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on (k, b), where a null k equals a null k."""
    r = right.withColumnsRenamed({"k": "rk", "b": "rb"})
    return left.join(r, left["k"].eqNullSafe(r["rk"]) & (left["b"] == r["rb"])).drop("rk", "rb")


def covered(start: Column, end: Column) -> Column:
    """Length of an interval, 0 where a bound is missing or they do not ascend."""
    return F.greatest(F.lit(0), F.coalesce(end - start, F.lit(0)))
