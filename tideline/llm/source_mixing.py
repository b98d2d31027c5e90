"""Mixes sources to target weights, with DataFrame operations only.

Source weights are token shares raised to an exponent between 0 (all sources alike) and 1 (as they are), and normalised.
The exponent is the smallest that brings the entropy of the weights down to its target and keeps the most repeated source
within its limit; both fall as it grows, so it is found by bisection, six halvings to a job over the table of source
totals. Where even 1 doesn't suffice, the shares stay as they are.

Weights times a budget of tokens give each source a number of whole passes and a rest. A pass is a permutation of the
source's blocks and of the documents in each block, drawn by hashes; the rest takes documents in that order while the
budget holds. Where it ends is found in three steps (slots of the permutation, blocks of one slot, documents of one
block), so no source is ever ordered in one task, and placing a document then needs only its own row and its source's.
Without a budget the source with the most tokens is passed once, so that no document is left out.

Defined results: null text has no tokens; tokens are runs of other characters than white space, unless given. A null source
is a source. Sources without any token are passed once and weigh nothing. Documents without tokens are placed with
their block. Rows that repeat an id share their places. An empty table gives no rows. Extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideline.session import scratch_folder

ENTROPY_SHARE = 0.98
MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 18
BROADCAST_SOURCES = 100_000
SLOT_BITS = 10
HASH_BITS = 60


def words(text: str) -> Column:
    """Runs of characters other than white space."""
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")).cast("bigint")


def draw(*parts: Column) -> Column:
    """A number of HASH_BITS bits from the parts written one after another."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _measures(totals: DataFrame, exponents: list[float], budget: int | None) -> list[tuple[float, float]]:
    """(entropy of the weights, passes of the most repeated source) for each exponent."""
    every = totals.filter("tokens > 0").withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    power = F.pow(F.col("share"), F.col("a"))
    found = every.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("a") * F.log("share")).alias("h"), F.max(power / F.col("tokens")).alias("most"),
        F.max_by(power / F.col("tokens"), "tokens").alias("largest"),
    )
    rows = {r["a"]: r for r in found.collect()}
    scale = [1 / rows[a]["largest"] if budget is None else budget / rows[a]["z"] for a in exponents]
    return [(math.log(rows[a]["z"]) - rows[a]["h"] / rows[a]["z"], s * rows[a]["most"]) for a, s in zip(exponents, scale, strict=True)]


def exponent(totals: DataFrame, entropy: float, max_repeats: float, budget: int | None = None) -> float:
    """The smallest exponent, in steps of a millionth, that meets both targets; 1 if none does."""

    def meets(measure: tuple[float, float]) -> bool:
        return measure[0] <= entropy + 1e-12 and measure[1] <= max_repeats + 1e-12

    low, high = 0.0, 1.0
    for turn in range(5):
        grid = [low + (high - low) * k / 64 for k in range(65)]
        good = [meets(m) for m in _measures(totals, grid, budget)]
        if turn == 0 and good[0]:
            return 0.0
        if True not in good:
            return 1.0
        k = good.index(True)
        low, high = grid[k - 1], grid[k]
    return math.ceil(high * 1e6) / 1e6


def plan(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", tokens: Column | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """One row per source: source, tokens, weight, n_blocks, passes (whole ones), and where the rest ends: documents whose
    (block_order, doc_order) in the pass after is at most (cut_block, cut_doc) belong to it.

    The entropy target is ``entropy_share`` of the way from the shares as they are to all sources alike."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "mixing")
    tokens = words("text") if tokens is None else tokens
    docs.select(F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), tokens.alias("tokens")).write.parquet(f"{folder}/documents")
    slim = spark.read.parquet(f"{folder}/documents")
    totals = slim.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = totals.agg(F.sum("tokens").alias("t"), F.sum((F.col("tokens") > 0).cast("int")).alias("n")).first()
    if not whole["t"]:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("bigint").alias("n_blocks"), F.lit(1).cast("bigint").alias("passes"), F.lit(-1).cast("bigint").alias("cut_block"), F.lit(-1).cast("bigint").alias("cut_doc"))
    totals.withColumn("share", F.col("tokens") / F.lit(float(whole["t"]))).write.parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    natural = _measures(totals, [1.0], budget)[0][0]
    chosen = exponent(totals, natural + entropy_share * (math.log(whole["n"]) - natural), max_repeats, budget)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("share"), F.lit(chosen))).otherwise(0.0)
    sums = totals.agg(F.sum(power).alias("z"), F.max_by(power, "tokens").alias("p"), F.max("tokens").alias("t")).first()
    amount = budget if budget is not None else sums["t"] * sums["z"] / sums["p"]
    weighed = totals.select("source", "tokens", (power / sums["z"]).alias("weight")).withColumn("wanted", F.round(F.col("weight") * amount).cast("bigint"))
    some = F.col("tokens") > 0
    shares = weighed.select(
        "source", "tokens", "weight", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("bigint").alias("n_blocks"),
        F.when(some, F.floor(F.expr("wanted div tokens"))).otherwise(1).cast("bigint").alias("passes"),
        F.when(some, F.expr("wanted % tokens")).otherwise(0).cast("bigint").alias("rest"), F.lit(whole["n"]).alias("_n"),
    )
    shares.write.parquet(f"{folder}/shares")
    shares = spark.read.parquet(f"{folder}/shares")
    partial = _ordered(_with_plan(slim, shares.filter("rest > 0"), "inner"), F.col("passes"), seed).select("source", "rest", "block_order", "doc_order", "tokens")
    slot = F.shiftright("block_order", HASH_BITS - SLOT_BITS)

    def running(rows: DataFrame, order: str) -> DataFrame:
        """Adds ``before``: what the rows of the source ahead of this one sum to, on top of ``base``."""
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy(order))
        return rows.withColumn("upto", F.col("base") + upto).withColumn("before", F.col("upto") - F.sum("tokens").over(Window.partitionBy("source", order)))

    over = (F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))
    slots = partial.groupBy("source", slot.alias("slot")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")).withColumn("base", F.lit(0).cast("bigint"))
    edge_slot = running(slots, "slot").filter(over).select(F.col("source").alias("s1"), F.col("slot").alias("edge"), F.col("before").alias("base"))
    in_slot = _small_join(partial, edge_slot, F.col("source").eqNullSafe(F.col("s1")) & (slot == F.col("edge")), whole["n"])
    blocks = in_slot.groupBy("source", "block_order").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("base").alias("base"))
    edge_block = running(blocks, "block_order").filter(over).select(F.col("source").alias("s2"), F.col("block_order").alias("edge"), F.col("before").alias("base"))
    in_block = _small_join(partial, edge_block, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block_order") == F.col("edge")), whole["n"])
    cuts = running(in_block, "doc_order").groupBy("source").agg(
        F.first("block_order").alias("cut_block"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("doc_order"))), F.lit(-1)).alias("cut_doc")
    ).withColumnRenamed("source", "s3")
    return shares.join(cuts, F.col("source").eqNullSafe(F.col("s3")), "left").select(
        "source", "tokens", "weight", "n_blocks", "passes", F.coalesce("cut_block", F.lit(-1)).alias("cut_block"), F.coalesce("cut_doc", F.lit(-1)).alias("cut_doc")
    )


def _small_join(left: DataFrame, right: DataFrame, on: Column, n: int) -> DataFrame:
    """``right`` has a row per source: it is broadcast where there are few sources, and joined by shuffle otherwise."""
    return left.join(F.broadcast(right) if n <= BROADCAST_SOURCES else right, on)


def _with_plan(rows: DataFrame, shares: DataFrame, how: str) -> DataFrame:
    n = shares.count()
    right = shares.drop("tokens", "weight").withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if n <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _ordered(rows: DataFrame, epoch: Column, seed: int) -> DataFrame:
    """Adds block, block_order and doc_order of the pass ``epoch``."""
    block = F.pmod(draw(F.lit(seed), F.col("doc_id")), F.col("n_blocks"))
    return rows.withColumn("block", block).withColumn("block_order", draw(F.lit(seed), F.col("source"), epoch, F.col("block"))).withColumn("doc_order", draw(F.lit(seed), F.col("doc_id"), epoch))


def placed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", tokens: Column | None = None, seed: int = 1, **targets) -> DataFrame:
    """Rows of ``docs`` once per pass they are in: struct ``row`` with all columns, source, doc_id, tokens, epoch, block,
    block_order, doc_order. Training order is (block_order, doc_order)."""
    tokens = words("text") if tokens is None else tokens
    shares = plan(docs, source, doc_id, tokens, seed=seed, **targets)
    folder = scratch_folder(docs.sparkSession, "mixing-plan")
    shares.write.parquet(folder)
    shares = docs.sparkSession.read.parquet(folder)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).cast("string").alias("source"), F.col(doc_id).alias("doc_id"), tokens.alias("tokens"))
    last = _ordered(_with_plan(rows, shares, "inner"), F.col("passes"), seed)
    within = (F.col("block_order") < F.col("cut_block")) | ((F.col("block_order") == F.col("cut_block")) & (F.col("doc_order") <= F.col("cut_doc")))
    times = F.col("passes") + F.when(within, 1).otherwise(0)
    every = last.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1)))).select("row", "source", "doc_id", "tokens", "epoch", "n_blocks")
    return _ordered(every, F.col("epoch"), seed).select("row", "source", "doc_id", "tokens", F.col("epoch").cast("int").alias("epoch"), "block", "block_order", "doc_order")


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """The documents' own columns, each row as often as the mix asks for."""
    return placed(docs, **targets).select("row.*")
