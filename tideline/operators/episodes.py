"""Runs of a condition, gaps between intervals, persistence of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.ordered import HOUR_MS, ordered_columns, previous_row, running_total


def episodes(df: DataFrame, keys: list[str], order: list[str], outside: Column, width: int = HOUR_MS, bounded=False) -> DataFrame:
    """Maximal runs of rows where ``outside`` holds: one row per run with its length and ends."""
    flagged = df.select(*keys, *order, F.coalesce(outside, F.lit(False)).alias("_out"))
    stepped = previous_row(flagged, keys, order, {"_before": "_out"}, width=width, bounded=bounded)
    starts = F.when(F.col("_out") & ~F.coalesce("_before", F.lit(False)), 1).otherwise(0)
    numbered = running_total(stepped, keys, order, {"run": starts}, width=width, bounded=bounded)
    return numbered.filter("_out").groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop")
    )


def coverage_gaps(done: DataFrame, keys: list[str], first: int | str, last: int | str, bounded=False) -> DataFrame:
    """Sub-ranges of [first, last] not covered by the (overlapping, unsorted) ranges in ``done`` (start, stop).

    ``first`` and ``last`` are numbers or columns that are constant per key."""
    lo = F.lit(first) if isinstance(first, int) else F.col(first)
    hi = F.lit(last) if isinstance(last, int) else F.col(last)
    body = done.select(*keys, F.col("start").cast("bigint"), F.col("stop").cast("bigint"), lo.cast("bigint").alias("_lo"), hi.cast("bigint").alias("_hi"))
    head = body.groupBy(*keys, "_lo", "_hi").agg(F.lit(0).alias("_z")).select(
        *keys, (F.col("_lo") - 1).alias("start"), (F.col("_lo") - 1).alias("stop"), "_lo", "_hi"
    )
    # The furthest covered point so far is a running maximum: compressed to one row per start first.
    rows = body.filter((F.col("stop") >= F.col("_lo")) & (F.col("start") <= F.col("_hi"))).unionByName(head)
    per_start = rows.groupBy(*keys, "_lo", "_hi", "start").agg(F.max("stop").alias("stop"))
    following = ordered_columns(per_start, keys, ["start"], 1_000_000, bounded=bounded, maxima={"_reached": "stop"}, following={"_next": "start"})
    gap_end = F.least(F.coalesce(F.col("_next") - 1, F.col("_hi")), F.col("_hi"))
    return following.select(*keys, (F.col("_reached") + 1).alias("gap_start"), gap_end.alias("gap_stop")).filter(
        F.col("gap_start") <= F.col("gap_stop")
    )


def running_maximum(df: DataFrame, keys: list[str], order: list[str], names: dict[str, str], width: int = 1_000_000, bounded=False) -> DataFrame:
    """Inclusive running maximum; slices carry the maximum of all earlier slices."""
    return ordered_columns(df, keys, order, width, bounded=bounded, maxima=names)


def log_returns(df: DataFrame, keys: list[str], order: list[str], price: str, width: int = HOUR_MS, bounded=False) -> DataFrame:
    """ln of each price over the previous one; the first row of a key has none."""
    stepped = previous_row(df, keys, order, {"_p": price}, width=width, bounded=bounded)
    return stepped.withColumn("log_return", F.ln(price) - F.ln("_p")).drop("_p")


def half_life(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = HOUR_MS, bounded=False) -> DataFrame:
    """ln(0.5)/ln(rho) with rho = sample covariance of (previous, current) over the population variance of previous."""
    stepped = previous_row(df, keys, order, {"_x": value}, width=width, bounded=bounded).filter(F.col("_x").isNotNull())
    fit = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_samp("_x", value), F.var_pop("_x")).alias("rho")
    )
    valid = (F.col("n") >= 100) & (F.col("rho") > 0) & (F.col("rho") < 1)
    return fit.withColumn("half_life", F.when(valid, F.ln(F.lit(0.5)) / F.ln("rho")))
