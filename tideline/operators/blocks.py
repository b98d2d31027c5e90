"""Block tables: intervals, change points, timestamp reconstruction and sampling.

Block numbers are unique integers, so ranges of numbers are slices of bounded size by construction: windows run per
range, and rows a window needs from the neighbouring range are copied there (a halo) instead of widening the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tideline.functions.clock import HOUR_MS, nominal_elapsed
from tideline.operators.ordered import carry_forward, next_row, previous_row

RANGE = 500_000
FORWARD_WINDOW = 60
SHORT_WINDOW = 10
SAMPLE_RUN = 30
MAX_LEAF = 48


def one_per_number(blocks: DataFrame, extra: list[str] = ()) -> DataFrame:
    """One header per block number (the earliest timestamp wins, so repeats are deterministic)."""
    return blocks.groupBy("number").agg(
        F.min("milli_ts").alias("milli_ts"), *[F.min_by(c, "milli_ts").alias(c) for c in extra]
    )


def with_intervals(blocks: DataFrame, keys: list[str] = (), bounded: bool = False) -> DataFrame:
    """Seconds since the previous block, only where the previous number is present."""
    keyed = blocks if keys else blocks.withColumn("_chain", F.lit(0))
    out = previous_row(
        keyed, list(keys) or ["_chain"], ["number"], {"_n": "number", "_t": "milli_ts"}, width=RANGE, bounded=bounded
    )
    gap = (F.col("milli_ts") - F.col("_t")) / F.lit(1000.0)
    return out.withColumn("interval", F.when(F.col("number") - F.col("_n") == 1, gap)).drop("_n", "_t", "_chain")


def with_forward_means(intervals: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Adds the next interval, the mean of the next 60 and of the next 10 (NULL unless all are present).

    Ranges of numbers carry a halo of the 60 rows that follow them."""
    home = F.floor(F.col("number") / F.lit(RANGE)).cast("bigint")
    first_rows = F.pmod(F.col("number"), F.lit(RANGE)) < F.lit(FORWARD_WINDOW + 1)
    homes = F.when(first_rows, F.array(home, home - 1)).otherwise(F.array(home))
    spread = intervals.select("number", "milli_ts", "interval", *keep, home.alias("_home"), F.explode(homes).alias("_range"))
    order = Window.partitionBy("_range").orderBy("number")
    long_ahead, short_ahead = order.rowsBetween(1, FORWARD_WINDOW), order.rowsBetween(1, SHORT_WINDOW)
    ahead = spread.select(
        "*",
        F.lead("interval").over(order).alias("next_interval"),
        F.when(F.count("interval").over(long_ahead) == FORWARD_WINDOW, F.avg("interval").over(long_ahead)).alias("mean60"),
        F.when(F.count("interval").over(short_ahead) == SHORT_WINDOW, F.avg("interval").over(short_ahead)).alias("mean10"),
    )
    return ahead.filter(F.col("_home") == F.col("_range")).drop("_home", "_range")


def change_point(intervals: DataFrame, threshold: float) -> DataFrame:
    """One row: the first block whose following interval is short and stays short, at or after the first block where
    the mean of the next 60 intervals falls below ``threshold``."""
    return change_point_by_column(intervals.withColumn("_limit", F.lit(float(threshold))), "_limit")


def change_point_by_column(intervals: DataFrame, limit: str) -> DataFrame:
    """As :func:`change_point`, with the threshold in a column that is the same on every row."""
    below = lambda c: F.col(c) < F.col("_limit")
    ahead = with_forward_means(intervals.withColumnRenamed(limit, "_limit"), ["_limit"])
    coarse = ahead.agg(F.min(F.when(below("mean60"), F.col("number"))).alias("coarse_block"))
    found = ahead.filter(below("next_interval") & below("mean10")).crossJoin(F.broadcast(coarse))
    fine = found.filter(F.col("number") >= F.col("coarse_block")).agg(F.min("number").alias("_fine"))
    return coarse.crossJoin(fine).select("coarse_block", F.coalesce("_fine", "coarse_block").alias("change_block"))


def number_spine(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """Every number of [start, stop] per key, generated range by range."""
    chunks = spans.select(
        *keys, F.col(stop).alias("_e"), F.explode(F.sequence(F.col(start), F.col(stop), F.lit(RANGE))).alias("_s")
    )
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions: chunks are few bytes that stand for many rows, and would be merged into one task.
    return chunks.repartition(parts, *keys, "_s").select(
        *keys, F.explode(F.sequence("_s", F.least(F.col("_e"), F.col("_s") + F.lit(RANGE - 1)))).alias("number")
    )


def fill_timestamps(anchors: DataFrame, change_block: int, pre_ms: int, post_ms: int, bounded=False) -> DataFrame:
    """Timestamps of every block between the first and last anchor: last anchor plus the scheduled time since it."""
    keyed = anchors.select(F.lit(0).alias("_chain"), "number", "milli_ts")
    span = keyed.groupBy("_chain").agg(F.min("number").alias("_s"), F.max("number").alias("_e"))
    spine = number_spine(span, ["_chain"], "_s", "_e").join(keyed, ["_chain", "number"], "left")
    spine = spine.withColumn("_a", F.when(F.col("milli_ts").isNotNull(), F.struct("number", "milli_ts")))
    filled = carry_forward(spine, ["_chain"], ["number"], {"_last": "_a"}, width=RANGE, bounded=bounded)
    elapsed = nominal_elapsed(F.col("_last.number"), F.col("number"), change_block, pre_ms, post_ms)
    return filled.select(
        "number",
        (F.col("_last.milli_ts") + elapsed).cast("bigint").alias("milli_ts"),
        F.col("milli_ts").isNotNull().alias("fetched"),
    )


def irregular_spans(anchors: DataFrame, change_block: int, pre_ms: int, post_ms: int, bounded=False) -> DataFrame:
    """Neighbouring anchors whose elapsed time is off schedule: (start, stop, excess_ms, too_fast)."""
    keyed = anchors.select(F.lit(0).alias("_chain"), "number", "milli_ts")
    pairs = next_row(keyed, ["_chain"], ["number"], {"stop": "number", "_t": "milli_ts"}, width=RANGE, bounded=bounded)
    excess = F.col("_t") - F.col("milli_ts") - nominal_elapsed(F.col("number"), F.col("stop"), change_block, pre_ms, post_ms)
    return (
        pairs.select(F.col("number").alias("start"), "stop", excess.cast("bigint").alias("excess_ms"))
        .filter(F.col("stop").isNotNull() & (F.col("excess_ms") != 0))
        .filter((F.col("stop") - F.col("start") > 1) | (F.col("excess_ms") < 0))
        .withColumn("too_fast", F.col("excess_ms") < 0)
    )


def refinement_requests(spans: DataFrame) -> DataFrame:
    """Headers to fetch next: all blocks inside a short irregular span, the midpoint of a long one."""
    inner = F.col("stop") - F.col("start") - 1
    asked = F.when(inner <= MAX_LEAF, F.sequence(F.col("start") + 1, F.col("stop") - 1)).otherwise(
        F.array(F.floor((F.col("start") + F.col("stop")) / 2).cast("bigint"))
    )
    return spans.filter(~F.col("too_fast") & (inner > 0)).select(F.explode(asked).alias("number")).distinct()


def anchor_samples(spans: DataFrame, first: str, last: str, step: int, run: int) -> DataFrame:
    """Runs of ``run`` consecutive block numbers starting every ``step`` blocks."""
    starts = spans.select(F.explode(F.sequence(F.col(first), F.col(last), F.lit(step))).alias("_s"), F.col(last).alias("_e"))
    return starts.select(
        F.col("_s").alias("run_start"),
        F.explode(F.sequence(F.col("_s"), F.least(F.col("_e"), F.col("_s") + F.lit(run - 1)))).alias("number"),
    )


def bracket_change_point(runs: DataFrame, threshold: float, run: int = SAMPLE_RUN) -> DataFrame:
    """(last slow run, first fast run + run length) from sampled runs (run_start, number, milli_ts)."""
    return bracket_change_point_by_column(runs.withColumn("_limit", F.lit(float(threshold))), "_limit", run)


def bracket_change_point_by_column(runs: DataFrame, limit: str, run: int = SAMPLE_RUN) -> DataFrame:
    """A run's mean interval needs only its ends; the crossing is the first fast run with a slow one before it."""
    steps = F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    means = runs.groupBy("run_start").agg(
        F.try_divide((F.max("milli_ts") - F.min("milli_ts")) / F.lit(1000.0), steps).alias("mean_interval"), F.max(limit).alias("_limit")
    )
    slow = F.when(F.col("mean_interval") >= F.col("_limit"), F.col("run_start"))
    tagged = means.withColumn("_slow", slow).withColumn("_chain", F.lit(0))
    seen = carry_forward(tagged, ["_chain"], ["run_start"], {"_last_slow": "_slow"}, width=RANGE)
    fast = seen.filter((F.col("mean_interval") < F.col("_limit")) & F.col("_last_slow").isNotNull())
    return fast.agg(
        F.min_by("_last_slow", "run_start").alias("slow_block"), (F.min("run_start") + F.lit(run)).alias("fast_block")
    )


def hourly_blocks(intervals: DataFrame) -> DataFrame:
    hour = F.col("milli_ts") - F.pmod(F.col("milli_ts"), F.lit(HOUR_MS))
    return intervals.groupBy(hour.alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        (1000 * F.avg("interval")).alias("interval_ms"),
        F.count("interval").alias("n_intervals"),
    )


def hourly_gas(headers: DataFrame) -> DataFrame:
    hour = F.col("milli_ts") - F.pmod(F.col("milli_ts"), F.lit(HOUR_MS))
    return headers.groupBy(hour.alias("hour_ms")).agg(
        F.count(F.lit(1)).alias("n_headers"), F.avg("gas_used").alias("gas_used"), F.avg("gas_limit").alias("gas_limit")
    )


def contiguity(blocks: DataFrame) -> DataFrame:
    """First, last, count and whether the numbers cover the range exactly."""
    return blocks.agg(
        F.min("number").alias("first_block"),
        F.max("number").alias("last_block"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("number").alias("n_numbers"),
    ).withColumn(
        "contiguous",
        (F.col("n_rows") == F.col("n_numbers")) & (F.col("last_block") - F.col("first_block") + 1 == F.col("n_rows")),
    )


def first_at_or_after(blocks: DataFrame, at_ms: int) -> DataFrame:
    return blocks.filter(F.col("milli_ts") >= at_ms).agg(F.min("number").alias("number"), F.min("milli_ts").alias("milli_ts"))
