"""As-of join of two streams: both are held per symbol and time span until the watermark has passed them, then each swap finds its tick."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.streaming.windows import with_event_time

SWAP_KEY = ("symbol", "pool", "block", "log_index")
# What a held row is: a swap, or a tick by the order of its price (null below numbers, NaN above them, as in Spark).
SWAP, NO_PRICE, NUMBER, NOT_A_NUMBER = -1, 0, 1, 2


def _packed(frame: pd.DataFrame) -> bytes:
    held = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as writer:
        writer.write_table(held)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(held) as reader:
        return reader.read_pandas()


def _due_swaps(within_ms: int):
    """What one (symbol, span) does in a batch: keeps what came, and answers the swaps that the watermark is ``within_ms`` past."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        symbol, span = key
        frames = [_unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            frames += [part[["ts_ms", "_key", "_price", "_kind"]] for part in parts]
        rows = pd.concat([f for f in frames if len(f)], ignore_index=True)
        passed = state.getCurrentWatermarkMs()
        is_swap = rows["_kind"] == SWAP
        swaps = rows[is_swap].drop_duplicates(["ts_ms", "_key"])
        ticks = rows[~is_swap].sort_values(["ts_ms", "_kind", "_price"]).drop_duplicates("ts_ms", keep="last")
        due = swaps["ts_ms"] + within_ms <= passed
        waiting = swaps[~due]
        last = (int(span) + 2) * within_ms - 1  # when the last swap of the span is due
        if len(waiting) or (len(ticks) and passed < last):
            state.update((_packed(pd.concat([waiting, ticks])),))
            at = int(waiting["ts_ms"].min()) + within_ms if len(waiting) else last
            state.setTimeoutTimestamp(max(at - 1, passed))  # runs out once the watermark is above it
        elif state.exists:
            state.remove()
        asked = swaps[due]
        if not len(asked):
            return
        times = asked["ts_ms"].to_numpy(np.int64)
        marks = np.empty(0, np.int64) if symbol is None else ticks["ts_ms"].to_numpy(np.int64)
        place = np.searchsorted(marks, times, side="right") - 1
        near = place >= 0
        near[near] = times[near] - marks[place[near]] <= within_ms
        found = place[near]
        age, price = pd.Series(pd.NA, index=range(len(asked)), dtype="Int64"), pd.Series(None, index=range(len(asked)), dtype=object)
        kind = np.full(len(asked), NO_PRICE, np.int32)
        if len(found):
            age[near] = times[near] - marks[found]
            price[near] = ticks["_price"].to_numpy(object)[found]
            kind[near] = ticks["_kind"].to_numpy(np.int32)[found]
        price[kind != NUMBER] = None
        yield pd.DataFrame({"symbol": [symbol] * len(asked), "_key": asked["_key"].to_numpy(object), "ts_ms": times, "p_cex": price, "age_ms": age, "_kind": kind})

    return step


def stream_as_of(swaps: DataFrame, ticks: DataFrame, within_ms: int = 600_000, delay: str = "10 minutes", keys: tuple[str, ...] = SWAP_KEY) -> DataFrame:
    """``keys``, ts_ms, p_cex and age_ms of every swap: price and age of the last tick of its symbol at most ``within_ms`` older.

    Both inputs have symbol and ts_ms and may arrive in any order within ``delay``; rows later than that are dropped and counted
    (``windows.dropped_as_late``; a tick once per span). ``keys`` identify a swap and hold the symbol; repeats of a swap count once.
    Both streams are dealt by symbol and spans of ``within_ms``, each tick to its own span and the next one, so a hot symbol is spread over
    tasks. A span is held as it came, one tick a millisecond, until its last swap is due; each swap looks its tick up in the ordered ones.
    No pairs are formed: work grows with the rows, however dense they lie. A swap
    is emitted once, when the watermark is ``within_ms`` past it; one without a tick in range gets nulls. Of ticks of one millisecond
    the highest price counts.
    Null symbols match nothing."""
    span = F.floor(F.col("ts_ms") / within_ms)
    rest = [c for c in keys if c != "symbol"]
    price = ticks.schema["price"].dataType
    key = T.StructType([swaps.schema[c] for c in rest])
    # Keys travel as text: as columns that ticks don't have they would turn into floating numbers.
    left = with_event_time(swaps, delay).select("ts", "ts_ms", "symbol", span.alias("_span"), F.to_json(F.struct(*rest)).alias("_key"),
                                                F.lit(None).cast(price).alias("_price"), F.lit(SWAP).alias("_kind"))
    kind = F.when(F.col("price").isNull(), NO_PRICE).when(F.isnan(F.col("price").cast("double")), NOT_A_NUMBER).otherwise(NUMBER)
    right = with_event_time(ticks, delay).select("ts", "ts_ms", "symbol", F.explode(F.array(span, span + 1)).alias("_span"), F.lit(None).cast("string").alias("_key"),
                                                 F.col("price").alias("_price"), kind.alias("_kind"))
    held = left.unionByName(right).filter("ts_ms IS NOT NULL").groupBy("symbol", "_span")
    out = T.StructType().add("symbol", swaps.schema["symbol"].dataType).add("_key", "string").add("ts_ms", "long").add("p_cex", price).add("age_ms", "long").add("_kind", "integer")
    found = held.applyInPandasWithState(_due_swaps(within_ms), out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    answer = F.col("p_cex") if price.typeName() not in ("double", "float") else F.when(F.col("_kind") == NOT_A_NUMBER, F.lit(float("nan")).cast(price)).otherwise(F.col("p_cex"))
    named = found.withColumn("_key", F.from_json("_key", key))
    return named.select(*[F.col("symbol") if c == "symbol" else F.col("_key")[c].alias(c) for c in keys], "ts_ms", answer.alias("p_cex"), "age_ms")
