"""Connected components by randomised contraction, as joins and aggregations.

Every round each vertex points to the neighbour (or itself) with the smallest random priority; edges are rewritten to
the chosen vertices and made distinct. A constant share of vertices disappears per round whatever the ids look like,
so the number of rounds grows with the logarithm of the graph. Every round and every fold is written, so that no plan holds
more than two joins, however many rounds there were. Hubs are ordinary rows of a partially aggregated
groupBy and of a join whose other side is unique, which adaptive execution can split.
(Bögeholz, Brand and Todor, "In-database connected component analysis", 2020.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.session import stored

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(member, component): component is the smallest member id. ``a`` and ``b`` are node columns of one type."""
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "edges")
    live = both.filter(F.col("u") != F.col("v"))
    members = both.select(F.col("u").alias("member")).union(both.select(F.col("v").alias("member"))).distinct()
    steps: list[DataFrame] = []
    seed = 0
    while not live.isEmpty():
        if seed >= MAX_ROUNDS:
            raise RuntimeError("components did not converge")
        seed += 1
        either = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))

        def priority(column: str):
            return F.struct(F.xxhash64(F.lit(seed), F.col(column)).alias("p"), F.col(column).alias("id"))

        nearest = either.groupBy("u").agg(F.min(priority("v")).alias("_best"))
        chosen = stored(nearest.select("u", F.least(F.col("_best"), priority("u"))["id"].alias("rep")), "chosen")
        steps.append(chosen)
        left = live.join(chosen.withColumnRenamed("rep", "ru"), "u")
        right = left.join(chosen.select(F.col("u").alias("v"), F.col("rep").alias("rv")), "v")
        live = stored(
            right.filter(F.col("ru") != F.col("rv"))
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct(),
            "live",
        )
    # Fold the pointers from the last round to the first: each fold is one join of two unique-key tables.
    folded = None
    for chosen in reversed(steps):
        if folded is None:
            folded = chosen
            continue
        after = folded.select(F.col("u").alias("rep"), F.col("rep").alias("_final"))
        folded = stored(chosen.join(after, "rep", "left").select("u", F.coalesce("_final", "rep").alias("rep")), "folded")
    if folded is None:
        return members.withColumn("component", F.col("member"))
    placed = members.join(folded, members["member"] == folded["u"], "left").select(
        "member", F.coalesce("rep", "member").alias("rep")
    )
    smallest = placed.groupBy("rep").agg(F.min("member").alias("component"))
    return stored(placed.join(smallest, "rep").select("member", "component"), "components")
