"""The reference store: one row per symbol and millisecond, partitioned by symbol and UTC date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions import clock
from tideline.operators.asof import last_per_bucket
from tideline.schemas import TICKS


def write_ticks(trades: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Last price of each millisecond, written by (symbol, date).

    Files are cut by symbol, date and hour, so one busy symbol-day is written by many tasks."""
    ticks = last_per_bucket(trades, ["symbol"], "ts_ms", "agg_id", "price").withColumn("date", clock.utc_date(F.col("ts_ms")))
    spread = ticks.repartition("symbol", "date", clock.hour_of_day(F.col("ts_ms")))
    spread.sortWithinPartitions("symbol", "ts_ms").write.mode(mode).partitionBy("symbol", "date").parquet(path)


def read_ticks(spark: SparkSession, path: str, first: date, last: date, symbols: list[str] | None = None) -> DataFrame:
    """Ticks of [first, last] plus the day before, which early-morning lookups need; other partitions are not read."""
    stored = spark.read.schema(TICKS).parquet(path)
    kept = stored.filter(F.col("date").between(F.lit(first - timedelta(days=1)), F.lit(last)))
    return kept.filter(F.col("symbol").isin(symbols)) if symbols else kept
