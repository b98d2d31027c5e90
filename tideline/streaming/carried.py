"""Micro-batches with carried tables: each batch runs a batch operator on (carried rows + new rows).

State of batch n is a small Parquet table at <state>/batch=<n>. A batch that is retried reads the state of the batch
before it and overwrites its own state and output, so delivery is exactly once. Batches must arrive in block order,
as chunks do in the batch pipeline; ``in_event_order`` makes such batches of a stream whose rows come in any order within a delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.asof import as_of
from tideline.operators.blocks import FORWARD_WINDOW, change_point, with_intervals
from tideline.operators.ordered import previous_row
from tideline.operators.slices import as_struct
from tideline.plans.enrich import BLOCK_SLICE, ORDER
from tideline.streaming.windows import with_event_time

Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def in_event_order(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``rows`` held in state until the watermark has passed them: each batch then has all rows of its stretch of time, after those of the batch before.

    State is dealt by whole rows, so that a hot key is held by all tasks; equal rows are held once with their number and come out as often as
    they came. Rows later than ``delay`` or without ts_ms are dropped."""
    held = with_event_time(rows.filter("ts_ms IS NOT NULL"), delay).groupBy("ts", *rows.columns).agg(F.count(F.lit(1)).alias("_times"))
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*rows.columns)


def run_carried(stream: DataFrame, step: Step, output: str, state: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that calls ``step(new rows, carried rows) -> (output rows, next carried rows)`` per batch."""

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carried = spark.read.parquet(f"{state}/batch={number - 1}") if number > 0 else None
        kept = batch.persist()
        try:
            rows, following = step(kept, carried)
            rows.write.mode("overwrite").parquet(f"{output}/batch={number}")
            following.write.mode("overwrite").parquet(f"{state}/batch={number}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def previous_state_step(names: dict[str, str], keys: list[str] = ("pool",), order: list[str] = tuple(ORDER), width: int = BLOCK_SLICE) -> Step:
    """Previous swap of each pool across batches; the carried table holds one row per pool. ``width``: span of a slice in ``order[0]``."""
    keys, order = list(keys), list(order)

    def step(batch: DataFrame, carried: DataFrame | None):
        rows = batch.withColumn("_old", F.lit(False))
        if carried is not None:
            rows = rows.unionByName(carried.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        seen = previous_row(rows, keys, order, names, width=width).filter("NOT _old").drop("_old")
        everything = as_struct(batch.columns)
        latest = rows.groupBy(*keys).agg(F.max_by(everything, as_struct(order)).alias("_r")).select("_r.*")
        return seen, latest

    return step


def change_point_step(threshold: float) -> Step:
    """Change point over a stream of blocks: a block is judged once the 60 intervals after it have arrived.

    The carried table keeps the last 71 blocks, so a window that spans batches is complete, and whether the change has been
    found: it is emitted once."""

    def step(batch: DataFrame, carried: DataFrame | None):
        columns = ["number", "milli_ts"]
        known = carried is not None and not carried.filter("found").isEmpty()
        rows = batch.select(*columns) if carried is None else batch.select(*columns).unionByName(carried.select(*columns))
        found = change_point(with_intervals(rows), threshold).filter(F.lit(not known) & F.col("coarse_block").isNotNull())
        newest = rows.agg(F.max("number").alias("_top"))
        tail = rows.crossJoin(F.broadcast(newest)).filter(F.col("number") > F.col("_top") - (FORWARD_WINDOW + 11)).select(*columns)
        return found, tail.withColumn("found", F.lit(known or not found.isEmpty()))

    return step


def run_as_of(swaps: DataFrame, read_ticks: Callable[[SparkSession, int | None, int], DataFrame], output: str, state: str, checkpoint: str) -> StreamingQuery:
    """Attaches the reference to every micro-batch from the tick store, however old the last tick is.

    ``read_ticks(spark, first_ms, last_ms)`` returns symbol, ts_ms, price and prunes partitions (``first_ms`` None: from the
    beginning); it must be complete up to the newest swap of the batch. The carried table holds, per symbol, the last tick
    at or before the earliest swap of the batch before; a batch with swaps older than that reads from the beginning."""

    def on_batch(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, batch.persist()
        try:
            low, high = kept.agg(F.min("ts_ms"), F.max("ts_ms")).first()
            carried = spark.read.parquet(f"{state}/batch={number - 1}") if number > 0 else None
            since = carried.agg(F.max("since_ms")).first()[0] if carried is not None else None
            if low is None:
                low = high = since if since is not None else 0
            if since is None or low < since:
                ticks = read_ticks(spark, None, high).select("symbol", "ts_ms", "price")
            else:
                ticks = read_ticks(spark, since + 1, high).select("symbol", "ts_ms", "price").unionByName(carried.filter("symbol IS NOT NULL").select("symbol", "ts_ms", "price"))
            out = as_of(kept, ticks, ["symbol"], F.col("ts_ms"), "ts_ms", {"p_cex": "price"})
            out.write.mode("overwrite").parquet(f"{output}/batch={number}")
            latest = ticks.filter(F.col("ts_ms") <= low).groupBy("symbol").agg(F.max_by("price", "ts_ms").alias("price"), F.max("ts_ms").alias("ts_ms"))
            marker = spark.range(1).select(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("bigint").alias("ts_ms"))
            latest.unionByName(marker).withColumn("since_ms", F.lit(low)).write.mode("overwrite").parquet(f"{state}/batch={number}")
        finally:
            kept.unpersist()

    return swaps.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
