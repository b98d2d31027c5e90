"""Cross-source checks: two deliveries of the same events, and two clocks for the same blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def source_diff(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that differ: keys found in one source only, and keys whose values are not identical (NULLs compare equal)."""
    a = first.select(*keys, F.struct(*values).alias("_a"))
    b = second.select(*keys, F.struct(*values).alias("_b"))
    status = F.when(F.col("_a").isNull(), "only_second").when(F.col("_b").isNull(), "only_first")
    same = reduce(lambda x, y: x & y, [F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")) for v in values])
    joined = a.join(b, keys, "full_outer").withColumn("status", status.when(~same, "different"))
    return joined.filter("status IS NOT NULL").select(*keys, "status", F.col("_a").alias("first"), F.col("_b").alias("second"))


def diff_summary(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return source_diff(first, second, keys, values).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def timestamp_crosscheck(swaps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Provider seconds against reconstructed milliseconds: rows compared and rows that disagree."""
    known = blocks.select(F.col("number").alias("block"), "milli_ts")
    j = swaps.filter("block_ts > 0").join(known, "block")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.floor(F.col("milli_ts") / 1000) != F.col("block_ts")).alias("mismatches"))
