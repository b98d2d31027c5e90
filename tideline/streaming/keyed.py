"""Previous row of every key in keyed state: values, lists and event-time timers of Spark's RocksDB state store.

Unlike ``carried``, input may arrive in any order within the delay, and Spark itself keeps, versions and clears the state. A key's rows
of one batch belong to one task: use ``carried.in_event_order`` with a carried table (which slices a key) where one pool holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.windows import with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB (a query takes the setting over when it starts)."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class PreviousRow(StatefulProcessor):
    """Holds rows until the watermark has passed them, then emits them in order with values of the row before."""

    def __init__(self, schema: T.StructType, order: list[str], names: dict[str, str], idle_ms: int):
        self.schema, self.names, self.idle_ms = schema, names, idle_ms
        self.columns = schema.names
        self.rank = [self.columns.index(c) for c in order]
        self.taken = [self.columns.index(c) for c in names.values()]
        self.time = self.columns.index("ts_ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.before = handle.getValueState("before", self.schema, ttlDurationMs=self.idle_ms) if self.idle_ms else handle.getValueState("before", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            part = chunk[self.columns]
            self.waiting.appendList(list(part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)))
            low = int(part["ts_ms"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[self.time] <= passed else later).append(tuple(row))
        if not ready:
            return
        ready.sort(key=lambda r: tuple(r[i] for i in self.rank))
        before = tuple(self.before.get()) if self.before.exists() else None
        out = []
        for row in ready:
            out.append(row + tuple(before[i] if before else None for i in self.taken))
            before = row
        self.before.update(before)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[self.time] for r in later))
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=[*self.columns, *self.names], dtype=object)

    def close(self) -> None:
        pass


def previous_in_order(swaps: DataFrame, keys: list[str], order: list[str], names: dict[str, str], delay: str = "10 minutes", idle_ms: int = 0) -> DataFrame:
    """``swaps`` plus ``names`` (new column to source column) of the key's previous row in ``order``, emitted once the watermark has passed a row.

    ``order`` must be non-null and agree with ts_ms; rows later than ``delay`` or without ts_ms are dropped. A key's first row gets nulls. State
    per key: the rows within the delay and one row before them, forgotten after ``idle_ms`` of processing time if that is set (0: kept)."""
    kept = swaps.filter("ts_ms IS NOT NULL")
    schema = swaps.schema
    added = [T.StructField(new, schema[source].dataType) for new, source in names.items()]
    processor = PreviousRow(schema, list(order), dict(names), idle_ms)
    return with_event_time(kept, delay).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType([*schema.fields, *added]), outputMode="Append", timeMode="EventTime")
