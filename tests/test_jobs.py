"""The whole pipeline on a small generated market with a known change point and known latency."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions import clock
from tideline.plans import jobs

START, MINUTES, LATENCY = 1_700_006_400_000, 240, 300
STEP_PRE, STEP_POST = 1_500, 750
GAMMA = 0.0005


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    rng = random.Random(12)
    root = str(tmp_path_factory.mktemp("study"))
    half = START + MINUTES * 30_000
    end = START + MINUTES * 60_000
    blocks, t, n = [], START, 1_000
    change = None
    while t < end:
        if change is None and t >= half:
            change = n
        blocks.append((n, t, True))
        t, n = t + (STEP_PRE if t < half else STEP_POST), n + 1
    ticks, price, t = [], 100.0, START - 5_000
    while t < end:
        price *= math.exp(rng.gauss(0, 2e-4))
        ticks.append((t, price, "REF"))
        t += rng.randrange(300, 900)
    # an arbitrageur per pool acts in the first block at least LATENCY after the price leaves the band
    swaps = []
    for pool in ("a", "b"):
        at, k = ticks[0][1] * (1 + (0.0002 if pool == "b" else 0.0)), 0
        i = 0
        for j, (number, bt, _) in enumerate(blocks):
            while i + 1 < len(ticks) and ticks[i + 1][0] <= bt - LATENCY:
                i += 1
            seen = ticks[i][1]
            dev = at / seen - 1
            if abs(dev) > GAMMA:
                at = seen * (1 + math.copysign(GAMMA * 0.9, dev))
                size = rng.uniform(1, 20) * (-1 if dev > 0 else 1)
                k += 1
                sender = rng.choice(["0xc1", "0xc2", "0xc3"])
                root_price = str(int(math.sqrt(at) * 2**96))
                swaps.append((pool, number, f"0xt{pool}{k}", k, sender, "0xr", str(int(-size * 1e6)), str(int(size * at * 1e6)), root_price, str(10**12 + k), 0, "0", "0", bt // 1000))
    write = lambda rows, schema, name, *parts: spark.createDataFrame(rows, schema).write.partitionBy(*parts).parquet(f"{root}/{name}")
    write(swaps, schemas.SWAPS, "swaps")
    write(blocks, schemas.BLOCKS, "blocks")
    write([(p, "t0", "t1", int(GAMMA * 1e6), True, 6, 6, "REF") for p in ("a", "b")], schemas.POOLS, "pools")
    tick_df = spark.createDataFrame(ticks, "ts_ms bigint, price double, symbol string").withColumn("date", clock.utc_date(F.col("ts_ms")))
    tick_df.write.partitionBy("symbol", "date").parquet(f"{root}/ticks")
    second = tick_df.groupBy("symbol", "date", clock.floor_ms(F.col("ts_ms"), 1_000).alias("ts_ms")).agg(F.max_by("price", "ts_ms").alias("close"))
    second.write.parquet(f"{root}/candles")
    tx = spark.createDataFrame(swaps, schemas.SWAPS).select(
        "block", "log_index", F.col("tx").alias("tx_hash"), F.concat(F.lit("0xw"), F.right("sender", F.lit(1)), F.pmod("log_index", F.lit(2)).cast("string")).alias("tx_from"),
        F.col("sender").alias("tx_to"), F.lit(1).cast("bigint").alias("tx_index"), F.lit(100_000).cast("bigint").alias("gas_used"), F.lit(10**9).cast("bigint").alias("gas_price_wei"), F.lit(1).alias("status"))
    tx.dropDuplicates(["block", "log_index"]).write.parquet(f"{root}/transactions")
    return jobs.Study(root, change, half, STEP_PRE, STEP_POST, ("a", "b"), series_step_ms=60_000, min_pair=20, outcomes=("overshoot_strict_bps", "n_arb", "volume"), windows=(7,))


def test_report_writes_every_table(spark, study):
    tables = jobs.report(spark, study)
    read = lambda name: spark.read.parquet(study.path(f"tables/{name}"))
    for name in tables:
        assert read(name).columns, name
    arbs = spark.read.parquet(study.path("arbs"))
    assert arbs.count() > 300
    stats = {(r.pool, r.regime): r for r in read("response_stats_all").collect()}
    for pool in ("a", "b"):
        pre, post = stats[(pool, "pre")], stats[(pool, "post")]
        assert pre.share_cex + pre.share_continuation + pre.share_same_block + pre.share_onchain + pre.share_long == pytest.approx(1)
        # waiting adds a uniform share of the interval to a fixed latency
        assert abs(pre.ell_q50 - LATENCY) < 250 and abs(post.ell_q50 - LATENCY) < 250
        assert post.tau_p50 < pre.tau_p50
    medians = {(r.pool, r.regime): r["median"] for r in read("turnbull_summary_all").collect()}
    assert all(abs(v - LATENCY) < 350 for v in medians.values())
    regime = {(r.pool, r.regime): r for r in read("regime_table").collect()}
    assert regime[("a", "pre")].block_interval_ms == pytest.approx(STEP_PRE, rel=0.01) and regime[("a", "post")].block_interval_ms == pytest.approx(STEP_POST, rel=0.01)
    daily = read("daily_table").agg(F.sum("swaps")).first()[0]
    assert daily == spark.read.parquet(study.path("enriched")).count()
    assert read("operators").count() == 3
    assert read("coverage").filter("coverage < 1").count() == 0


def test_audit(spark, study):
    swaps = readers_swaps(spark, study)
    same = jobs.source_audit(spark, swaps, swaps, spark.read.parquet(study.path("blocks")))
    assert same["differences"].count() == 0 and same["clock"].first().mismatches == 0
    missing = jobs.source_audit(spark, swaps, swaps.filter("log_index <> 3"), spark.read.parquet(study.path("blocks")))
    assert {r.status for r in missing["summary"].collect()} == {"only_first"}


def test_candle_reference(spark, study):
    """The last candle that ended at least a second before the swap."""
    from tideline.plans import enrich

    swaps = spark.read.parquet(study.path("enriched")).select("pool", "symbol", "block", "log_index", "ts_ms", "p_cex")
    candles = spark.read.parquet(study.path("candles"))
    got = enrich.with_candle_reference(swaps.drop("p_cex"), candles, {"5": 5_000})
    closes = {r.ts_ms: r.close for r in candles.collect()}
    stamps = sorted(closes)
    import bisect

    for r in got.orderBy("pool", "block").limit(50).collect():
        at = lambda q: closes[stamps[bisect.bisect_right(stamps, q) - 1]]
        assert r.p_cex == at(r.ts_ms - 1_000) and r.p_cex_h5 == at(r.ts_ms + 5_000)


def readers_swaps(spark, study):
    from tideline.sources.readers import read_table

    return read_table(spark, study.path("swaps"), schemas.SWAPS).filter("pool = 'a'")
