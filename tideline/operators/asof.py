"""As-of lookups: the last reference value at or before a query time.

Both sides are stacked into one ordered stream per key and the reference is carried forward, so the work is one
shuffle of linear size; slices keep a hot symbol or a hot hour out of a single task. At equal times the reference
row sorts first, which makes the comparison inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.ordered import HOUR_MS, carry_forward

_Q, _SIDE = "_q", "_side"


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    query_time: Column,
    right_time: str,
    values: dict[str, str],
    width: int = HOUR_MS,
    bounded: bool = False,
) -> DataFrame:
    """Left rows plus ``values`` (new column -> right column) as of ``query_time``; NULL before the first right row.

    ``right`` has at most one row per (keys, right_time): collapse it with ``last_per_bucket`` first."""
    payload = F.struct(*[F.col(c) for c in left.columns])
    queries = left.select(*keys, query_time.cast("bigint").alias(_Q), F.lit(1).alias(_SIDE), payload.alias("_row"))
    answers = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    marks = right.select(*keys, F.col(right_time).cast("bigint").alias(_Q), F.lit(0).alias(_SIDE), answers.alias("_ref"))
    stacked = queries.unionByName(marks, allowMissingColumns=True)
    filled = carry_forward(stacked, keys, [_Q, _SIDE], {"_seen": "_ref"}, width=width, bounded=bounded)
    return filled.filter(F.col(_SIDE) == 1).select(
        *[F.col("_row")[c].alias(c) for c in left.columns], *[F.col("_seen")[new].alias(new) for new in values]
    )


def as_of_many(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    row_key: list[str],
    queries: dict[str, tuple[Column, str]],
    right_time: str,
    width: int = HOUR_MS,
    bounded: bool = False,
) -> DataFrame:
    """Several query times per row in one pass: ``queries`` maps new column -> (query time, right column).

    Each left row becomes one slim query per time (the full row travels once), all are answered by a single
    carried-forward pass and folded back on ``row_key``."""
    tags = list(queries)
    payload = F.struct(*[F.col(c) for c in left.columns])
    slim = left.select(
        *keys,
        *[F.col(c).alias(f"_k_{c}") for c in row_key],
        payload.alias("_row"),
        F.posexplode(F.array(*[queries[t][0].cast("bigint") for t in tags])).alias("_tag", _Q),
    ).withColumn("_row", F.when(F.col("_tag") == 0, F.col("_row")))
    sources = sorted({src for _, src in queries.values()})
    marks = right.select(
        *keys,
        F.col(right_time).cast("bigint").alias(_Q),
        F.lit(0).alias(_SIDE),
        F.struct(*[F.col(s) for s in sources]).alias("_ref"),
    )
    stacked = slim.withColumn(_SIDE, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    filled = carry_forward(stacked, keys, [_Q, _SIDE], {"_seen": "_ref"}, width=width, bounded=bounded)
    folded = (
        filled.filter(F.col(_SIDE) == 1)
        .groupBy(*[f"_k_{c}" for c in row_key])
        .agg(
            F.first("_row", ignorenulls=True).alias("_row"),
            *[
                F.max(F.when(F.col("_tag") == i, F.col("_seen")[queries[t][1]])).alias(f"_v_{t}")
                for i, t in enumerate(tags)
            ],
        )
    )
    return folded.select(
        *[F.col("_row")[c].alias(c) for c in left.columns], *[F.col(f"_v_{t}").alias(t) for t in tags]
    )


def looked_up(rows: DataFrame, times: DataFrame, answers: list[str]) -> DataFrame:
    """``rows`` with the columns ``answers`` of ``times``, which has one row per value of its other columns."""
    shared = [c for c in times.columns if c not in answers]
    renamed = times.select(*[F.col(c).alias(f"_at_{c}") for c in shared], *answers)
    condition = None
    for c in shared:
        equal = F.col(c).eqNullSafe(F.col(f"_at_{c}"))
        condition = equal if condition is None else condition & equal
    return rows.join(renamed, condition, "left").drop(*[f"_at_{c}" for c in shared])


def cross_rate(base: DataFrame, quote: DataFrame, keys: list[str], time: str, price: str, bounded=False) -> DataFrame:
    """Price of base over quote on the union of both legs' timestamps, each leg as of that time; both must exist."""
    legs = base.select(*keys, time, F.col(price).alias("_base")).unionByName(
        quote.select(*keys, time, F.col(price).alias("_quote")), allowMissingColumns=True
    )
    merged = legs.groupBy(*keys, time).agg(F.max("_base").alias("_base"), F.max("_quote").alias("_quote"))
    filled = carry_forward(merged, keys, [time], {"_b": "_base", "_q2": "_quote"}, bounded=bounded)
    return filled.filter(F.col("_b").isNotNull() & (F.col("_q2") != 0)).select(
        *keys, time, (F.col("_b") / F.col("_q2")).alias(price)
    )


def last_per_bucket(df: DataFrame, keys: list[str], time: str, seq: str, price: str, width_ms: int = 1) -> DataFrame:
    """Last price of every ``width_ms`` bucket, ties in time broken by ``seq``."""
    bucket = F.col(time) if width_ms == 1 else F.col(time) - F.pmod(F.col(time), F.lit(width_ms))
    return df.groupBy(*keys, bucket.alias("_t")).agg(
        F.max_by(price, F.struct(time, seq)).alias(price)
    ).withColumnRenamed("_t", time)


def time_grid(spans: DataFrame, keys: list[str], start: str, stop: str, step_ms: int, name: str) -> DataFrame:
    """Every step from ``start`` to ``stop`` per key, generated a day of steps at a time so no array grows large."""
    chunk = step_ms * max(1, 86_400_000 // step_ms)
    first = F.col(start) - F.pmod(F.col(start), F.lit(step_ms))
    days = spans.select(
        *keys, first.alias("_s"), F.col(stop).alias("_e"), F.explode(F.sequence(first, F.col(stop), F.lit(chunk))).alias("_d")
    )
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A given number of partitions: days are few bytes that stand for many rows, and would be merged into one task.
    return days.repartition(parts, *keys, "_d").select(
        *keys,
        F.explode(
            F.sequence(F.col("_d"), F.least(F.col("_e"), F.col("_d") + F.lit(chunk - step_ms)), F.lit(step_ms))
        ).alias(name),
    )


def grid_join(
    spans: DataFrame, series: dict[str, tuple[DataFrame, str]], keys: list[str], time: str, step_ms: int, bounded=False
) -> DataFrame:
    """Complete grid per key with each series (name -> (frame, value column)) carried forward on it.

    Rows before every series has started are dropped."""
    grid = time_grid(spans, keys, "t0", "t1", step_ms, time)
    for name, (frame, value) in series.items():
        grid = grid.join(frame.select(*keys, time, F.col(value).alias(f"_raw_{name}")), [*keys, time], "left")
    filled = carry_forward(grid, keys, [time], {n: f"_raw_{n}" for n in series}, bounded=bounded)
    return filled.drop(*[f"_raw_{n}" for n in series]).na.drop(subset=list(series))
