"""Exact quantiles per group (linear interpolation) that never gather a group in one task.

Values are first counted per (group, value), which is an even shuffle and removes ties. Groups are then narrowed in
two steps of value bins (logarithmic, then linear inside the bin): the bin counts locate the bin holding each wanted
rank, and only the values of those bins are ordered. The counts and the bins found are written: bins are few, and with the
size of their files known the counts are met where they lie instead of being dealt again. ``summarise`` folds quantiles and ordinary aggregates together;
``bounded`` asks for Spark's own exact ``percentile`` in the same aggregation, for groups small by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.session import stored

PER_OCTAVE = 64
OFFSET = 70_000
SUB_BINS = 65_536


@dataclass(frozen=True)
class Quantile:
    """One wanted statistic: quantile ``q`` of ``value`` (NULLs are skipped, so conditions go into the column)."""

    name: str
    value: Column
    q: float


def _bins(value: Column) -> tuple[Column, Column]:
    level = F.log2(F.abs(value)) * PER_OCTAVE
    octave = F.floor(level)
    coarse = F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * (octave + OFFSET)).cast("bigint")
    fine = F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * F.floor((level - octave) * SUB_BINS)).cast("bigint")
    return coarse, fine


def _locate(counts: DataFrame, group: list[str], by: str) -> DataFrame:
    """``counts`` carries in ``_asked`` the ranks wanted within the group. For each of them the ``by`` value whose run of counts covers it, with the rank inside that
    run; ranks that fall on the same value stay together, one row per group and value."""
    window = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_n").over(window)
    running = counts.withColumn("_before", upto - F.col("_n"))
    inside = F.filter("_asked", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_n")))
    moved = F.transform(inside, lambda w: F.struct(w["name"].alias("name"), w["side"].alias("side"), w["frac"].alias("frac"), (w["rank"] - F.col("_before")).alias("rank")))
    return running.withColumn("_asked", moved).filter(F.size("_asked") > 0).select(*group, by, "_asked")


def exact_quantiles(df: DataFrame, by: list[str], wanted: list[Quantile]) -> DataFrame:
    """(by..., one column per wanted quantile), every group's rows spread over the cluster.

    The input is read once; the counts by value are written, and the steps read those."""
    metrics: list[tuple[str, Column]] = []
    jobs: list[tuple[str, int, float]] = []
    for item in wanted:
        shown = str(item.value)
        index = next((i for i, (text, _) in enumerate(metrics) if text == shown), None)
        if index is None:
            index = len(metrics)
            metrics.append((shown, item.value))
        jobs.append((item.name, index, float(item.q)))
    group = [*[f"_g{i}" for i in range(len(by))], "_metric"]
    long = df.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)],
        F.posexplode(F.array(*[col.cast("double") for _, col in metrics])).alias("_metric", "_value"),
    ).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    for i in range(len(by)):  # NULL group keys must survive the equi-joins below
        long = long.withColumn(f"_g{i}", F.struct(F.col(f"_g{i}").isNull().alias("n"), F.col(f"_g{i}").alias("v")))
    coarse, fine = _bins(F.col("_value"))
    counted = stored(long.groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_n")), "counts").withColumn("_c", coarse).withColumn("_f", fine)
    coarse_counts = counted.groupBy(*group, "_c").agg(F.sum("_n").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(*group))

    def rank(name: str, q: float, side: int) -> Column:
        position = F.lit(q) * (total - 1)
        whole = (F.floor(position) if side == 0 else F.ceil(position)).cast("bigint")
        return F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (position - F.floor(position)).alias("frac"), whole.alias("rank"))

    asked = F.array(*[F.array(*[rank(name, q, side) for name, index, q in jobs if index == m for side in (0, 1)]) for m in range(len(metrics))])
    step1 = stored(_locate(coarse_counts.withColumn("_asked", asked[F.col("_metric")]), group, "_c"), "bins")
    fine_counts = counted.join(step1, [*group, "_c"]).groupBy(*group, "_c", "_f").agg(F.sum("_n").alias("_n"), F.any_value("_asked").alias("_asked"))
    step2 = stored(_locate(fine_counts, [*group, "_c"], "_f"), "bins")
    step3 = _locate(counted.join(step2, [*group, "_c", "_f"]), [*group, "_c", "_f"], "_value")
    found = step3.select(*group, "_value", F.explode("_asked").alias("_a"))
    low, high = F.max(F.when(F.col("_a.side") == 0, F.col("_value"))), F.max(F.when(F.col("_a.side") == 1, F.col("_value")))
    picked = found.groupBy(*group, F.col("_a.name").alias("_name")).agg((low + (high - low) * F.max("_a.frac")).alias("_value"))
    keys = group[:-1]
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name, _, _ in jobs]
    )
    return wide.select(*[F.col(f"_g{i}.v").alias(c) for i, c in enumerate(by)], *[name for name, _, _ in jobs])


def summarise(
    df: DataFrame, by: list[str], aggs: list[Column], quantiles: list[Quantile], bounded: bool = False
) -> DataFrame:
    """One row per group with ordinary aggregates and exact quantiles."""
    if not quantiles:
        return df.groupBy(*by).agg(*aggs)
    if bounded:
        return df.groupBy(*by).agg(
            *aggs, *[F.percentile(item.value.cast("double"), F.lit(item.q)).alias(item.name) for item in quantiles]
        )
    marked = df if by else df.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    base = marked.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    found = exact_quantiles(marked, keys, quantiles)
    renamed = found.select(*[F.col(c).alias(f"_j_{c}") for c in keys], *[item.name for item in quantiles])
    condition = None
    for c in keys:
        equal = base[c].eqNullSafe(renamed[f"_j_{c}"])
        condition = equal if condition is None else condition & equal
    out = base.join(renamed, condition, "left").drop(*[f"_j_{c}" for c in keys], "_rows")
    return out if by else out.drop("_all")
