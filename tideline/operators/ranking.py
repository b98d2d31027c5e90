"""Top-n, concentration and rank statistics from counts, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group under a total order; Catalyst prunes each partition to n rows before the shuffle."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def sample_per_group(df: DataFrame, by: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """Reproducible sample of ``n`` rows per group without replacement: the n smallest seeded key hashes."""
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
    return top_n(df.withColumn("_draw", draw), by, [F.col("_draw"), *[F.col(c) for c in key]], n).drop("_draw", "rank")


def concentration(counts: DataFrame, by: list[str], count: str = "n", volume: str | None = None, active: int = 20) -> DataFrame:
    """Members, HHI, top-1/3/5 shares, members needed for 90 %, members with at least ``active``.

    Members are grouped by their count first. At most about sqrt(2 x total) distinct counts exist, so the ordered
    step runs on that short table however many members a group has. Shares are compared in whole numbers."""
    levels = counts.groupBy(*by, F.col(count).cast("bigint").alias("_c")).agg(
        F.count(F.lit(1)).alias("_m"), *([F.sum(volume).alias("_v"), F.sum(F.col(volume) * F.col(volume)).alias("_vv")] if volume else [])
    )
    group = Window.partitionBy(*by)
    before = group.orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = levels.select(
        "*",
        F.sum(F.col("_c") * F.col("_m")).over(group).alias("_total"),
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_m0"),
        F.coalesce(F.sum(F.col("_c") * F.col("_m")).over(before), F.lit(0)).alias("_s0"),
    )

    def share_of_top(k: int) -> Column:
        taken = F.greatest(F.lit(0), F.least(F.col("_m"), F.lit(k) - F.col("_m0")))
        return (F.sum(taken * F.col("_c")) / F.max("_total")).alias(f"top{k}_share")

    # Members j = 1.._m of a level still below 90 %: 10*(s0 + j*c) < 9*total.
    room = F.lit(9) * F.col("_total") - F.lit(10) * F.col("_s0")
    below = F.when(room <= 0, F.lit(0)).otherwise(
        F.least(F.col("_m"), F.floor((room - 1) / (F.lit(10) * F.col("_c"))).cast("bigint"))
    )
    aggs = [
        F.sum("_m").alias("n_members"),
        F.sum(F.col("_c") * F.col("_m")).alias("n_total"),
        (F.sum(F.col("_m") * F.col("_c") * F.col("_c")) / (F.max("_total") * F.max("_total").cast("double"))).alias("hhi_count"),
        share_of_top(1),
        share_of_top(3),
        share_of_top(5),
        (F.sum(below) + 1).alias("n_for_90pct"),
        F.sum(F.when(F.col("_c") >= active, F.col("_m")).otherwise(0)).alias("n_active"),
    ]
    if volume:
        aggs.append(F.try_divide(F.sum("_vv"), F.sum("_v") * F.sum("_v")).alias("hhi_volume"))
    return placed.groupBy(*by).agg(*aggs)


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_points: int = 5) -> DataFrame:
    """Rank correlation with average ranks. Ties are collapsed to (value, count) before ranks are assigned."""

    def ranks(column: str, name: str) -> DataFrame:
        counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
        window = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum("_n").over(window)
        return counted.select(*by, column, (upto - (F.col("_n") - 1) / F.lit(2.0)).alias(name))

    both = df.select(*by, x, y).join(ranks(x, "_rx"), [*by, x]).join(ranks(y, "_ry"), [*by, y])
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_points, F.corr("_rx", "_ry")).alias("rho"),
    )


def quantile_bins(df: DataFrame, by: list[str], value: str, pieces: int, name: str) -> DataFrame:
    """Bin number 0..pieces-1 by linear-interpolated quantile edges of the group, each bin closed on the right."""
    from tideline.operators.quantiles import Quantile, summarise

    edges = summarise(df, by, [], [Quantile(f"_e{i}", F.col(value), i / pieces) for i in range(1, pieces)])
    joined = df.join(edges, by, "left")
    position = sum((F.when(F.col(value) > F.col(f"_e{i}"), 1).otherwise(0) for i in range(1, pieces)), F.lit(0))
    return joined.withColumn(name, position).drop(*[f"_e{i}" for i in range(1, pieces)])
