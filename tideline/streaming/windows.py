"""Event-time windows, sessions, running totals and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tideline.plans.panel import total, when


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(swaps: DataFrame, delay: str) -> DataFrame:
    return swaps.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def windowed_panel(swaps: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Sums of the hourly panel per pool and event-time window; pass ``slide`` for overlapping windows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = with_event_time(swaps, delay).groupBy(window.alias("w"), "pool").agg(
        F.count(F.lit(1)).alias("swaps"), F.sum("volume_q").alias("volume"), F.sum("fee_income").alias("fee_income"), F.sum("arb_loss").alias("arb_loss"),
        F.count_if("is_arb").alias("n_arb"), total("is_arb", "volume_q").alias("arb_volume"), F.avg(F.abs("dev_pre")).alias("mean_abs_dev_pre"),
    )
    return grouped.select(F.unix_millis("w.start").alias("hour_ms"), *[c for c in grouped.columns if c != "w"])


def bucket_last(trades: DataFrame, keys: list[str], price: str, order: list[str], delay: str = "10 minutes", length: str = "1 minute") -> DataFrame:
    """Last price of every bucket."""
    grouped = with_event_time(trades, delay).groupBy(F.window("ts", length).alias("w"), *keys).agg(F.max_by(price, F.struct(*order)).alias(price))
    return grouped.select(*keys, F.unix_millis("w.start").alias("ts_ms"), price)


def outside_sessions(series: DataFrame, keys: list[str], outside: Column, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Episodes outside the band: sessions of outside rows separated by more than ``gap``."""
    kept = with_event_time(series, delay).filter(outside)
    grouped = kept.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("length"), F.min("ts_ms").alias("start"), F.max("ts_ms").alias("stop"))
    return grouped.drop("w")


def running_totals(swaps: DataFrame, change_block: int) -> DataFrame:
    """Regime sums per pool, updated with every batch."""
    regime = F.when(F.col("block") < change_block, "pre").otherwise("post").alias("regime")
    return swaps.groupBy("pool", regime).agg(
        F.count(F.lit(1)).alias("swaps"), F.sum("volume_q").alias("volume_q"), F.count_if("is_arb").alias("n_arb"), F.sum("fee_income").alias("fee_income"),
        F.sum("arb_loss").alias("arb_loss"), F.sum(when("is_arb", "arb_loss")).alias("arb_loss_arbs"),
    )


def running_blocks(swaps: DataFrame, change_block: int, delay: str = "10 minutes") -> DataFrame:
    """Blocks with a swap per pool and regime; a block seen in two batches counts once."""
    once = with_event_time(swaps, delay).dropDuplicatesWithinWatermark(["pool", "block"])
    regime = F.when(F.col("block") < change_block, "pre").otherwise("post").alias("regime")
    return once.groupBy("pool", regime).agg(F.count(F.lit(1)).alias("blocks_with_swap"))


def deduplicated(rows: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """First delivery of each key; repeats within the delay and rows later than it are dropped (and counted in the
    query progress)."""
    return with_event_time(rows, delay).dropDuplicatesWithinWatermark(keys).drop("ts")


def dropped_as_late(query) -> int:
    """Rows the watermark discarded so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress for op in progress["stateOperators"])
