"""Ordered slices: cut every key's ordered rows into pieces of bounded size that still sort by (bucket, part).

A window over a whole key puts that key in one task; a window over (key, bucket) still fails when one bucket is hot.
Here the order column is cut into fixed buckets, buckets holding more than ``max_rows`` rows are cut again at
quantiles of the order column, and the operators in ``ordered`` carry state from slice to slice through a table
with one row per slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import cut_lineage

BUCKET, PART = "_bucket", "_part"
SLICE = [BUCKET, PART]
MAX_ROWS = 4_000_000


def hot_edges(df: DataFrame, keys: list[str], order: str, width: int, max_rows: int = MAX_ROWS) -> DataFrame | None:
    """Cut points for the buckets above ``max_rows``: (keys, bucket, edges), or None when no bucket is that full.

    One count job; a quantile sketch runs on the hot buckets only. The cut points are checkpointed, so every
    consumer in a plan sees the same ones."""
    counted = (
        df.groupBy(*keys, F.floor(F.col(order) / F.lit(width)).cast("bigint").alias(BUCKET))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > max_rows)
    )
    hot = cut_lineage(counted)
    if hot.isEmpty():
        return None
    widest = hot.agg(F.max("_rows")).first()[0]
    pieces = min(10_000, 2 * (-(-widest // max_rows)))
    cuts = [i / pieces for i in range(1, pieces)]
    sketched = (
        df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)).cast("bigint"))
        .join(hot, [*keys, BUCKET], "left_semi")
        .groupBy(*keys, BUCKET)
        .agg(F.array_distinct(F.percentile_approx(F.col(order).cast("double"), cuts, 20 * pieces)).alias("_edges"))
    )
    return cut_lineage(sketched)


def with_slices(df: DataFrame, keys: list[str], order: str, width: int, edges: DataFrame | None) -> DataFrame:
    """Adds ``_bucket`` and ``_part``; both grow with ``order`` inside a key."""
    out = df.withColumn(BUCKET, F.floor(F.col(order) / F.lit(width)).cast("bigint"))
    if edges is None:
        return out.withColumn(PART, F.lit(0))
    position = F.size(F.filter(F.col("_edges"), lambda edge: edge < F.col(order).cast("double")))
    return (
        out.join(edges, [*keys, BUCKET], "left")
        .withColumn(PART, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(position))
        .drop("_edges")
    )


def as_struct(cols: list[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])
