"""One arbitrage per opening rule, worked out by hand."""

import pytest

from tideline.operators.openings import blocks_waited, classify_openings, last_inside_band, with_opening_sizes

GAMMA = 0.01
SEARCH = 120_000
# pool price before every arbitrage is 100; the band is [100/1.01, 100/0.99] = [99.0099, 101.0101] around it
TICKS = [
    (1_000, 100.0), (2_000, 100.5), (3_000, 102.0), (4_000, 102.5),  # crossed at 3000
    (200_000, 103.0), (201_000, 103.5),
    (400_000, 103.0), (410_000, 102.2),
    (900_000, 104.0),
]
ARB = "block bigint, log_index bigint, ts_ms bigint, prev_ts_ms bigint, prev_dev_pre double, prev_dev_post double, dev_pre double"
ARBS = [
    (1, 1, 4_500, 500, 0.0, 0.0, -0.0244),  # an inside tick exists: cex, opened by the tick after it
    (2, 1, 5_000, 5_000, 0.0, -0.02, -0.0244),  # previous swap in the same block
    (3, 1, 201_500, 190_000, 0.0, 0.005, -0.0338),  # previous swap left it inside, first tick already outside: cex
    (4, 1, 411_000, 250_000, 0.0, -0.03, -0.0215),  # search stops before the previous swap
    (5, 1, 450_000, 420_000, 0.001, -0.02, -0.0215),  # previous swap pushed it out
    (6, 1, 460_000, 455_000, -0.03, -0.02, -0.0215),  # it was outside before the previous swap
]
WANT = {
    1: ("cex", 3_000, 1_500), 2: ("same_block", 5_000, 0), 3: ("cex", 200_000, 1_500), 4: ("long", -1, -1),
    5: ("onchain", 420_000, 30_000), 6: ("continuation", 455_000, 5_000),
}


@pytest.fixture(scope="module", params=[True, False])
def opened(spark, request):
    arbs = spark.createDataFrame([("p", 100.0, GAMMA, *a) for a in ARBS], "pool string, p_pre double, fee_rate double, " + ARB)
    ticks = spark.createDataFrame([("s", t, p) for t, p in TICKS], "symbol string, ts_ms bigint, price double")
    pools = spark.createDataFrame([("p", "s")], "pool string, symbol string")
    ranges = last_inside_band(arbs, ticks, pools, SEARCH, bounded=request.param)
    return with_opening_sizes(classify_openings(arbs, ranges, SEARCH)).cache()


def test_rules(opened):
    got = {r.block: (r.trigger, r.t_open, r.tau_ms) for r in opened.collect()}
    assert got == WANT


def test_wider_bands(opened):
    rows = {r.block: r for r in opened.collect()}
    # band of 2 gamma is [98.04, 102.04]: the tick at 3000 is inside it, so the wider band opened at 4000
    assert (rows[1].trigger_m20, rows[1].tau_ms_m20) == ("cex", 500)
    assert rows[1].trigger_m15 == "cex"


def test_below_threshold_comes_first(spark):
    arbs = spark.createDataFrame([("p", 100.0, GAMMA, 1, 1, 4_500, 500, 0.0, 0.0, -0.012)], "pool string, p_pre double, fee_rate double, " + ARB)
    ticks = spark.createDataFrame([("s", t, p) for t, p in TICKS], "symbol string, ts_ms bigint, price double")
    pools = spark.createDataFrame([("p", "s")], "pool string, symbol string")
    r = classify_openings(arbs, last_inside_band(arbs, ticks, pools, SEARCH), SEARCH).first()
    assert (r.trigger, r.trigger_m15, r.tau_ms_m15, r.trigger_m20) == ("cex", "below_threshold", -1, "below_threshold")


def test_no_ticks(spark):
    from pyspark.sql import functions as F

    arbs = spark.createDataFrame([("p", 100.0, GAMMA, *ARBS[0])], "pool string, p_pre double, fee_rate double, " + ARB)
    ticks = spark.createDataFrame([], "symbol string, ts_ms bigint, price double")
    pools = spark.createDataFrame([("p", "s")], "pool string, symbol string")
    r = classify_openings(arbs, last_inside_band(arbs, ticks, pools, SEARCH), SEARCH, has_ticks=F.lit(False)).first()
    assert (r.trigger, r.t_open, r.tau_ms) == ("no_ticks", -1, -1)


def test_jump_and_move_add_up(opened):
    for r in opened.collect():
        if r.trigger == "cex":
            assert r.jump_bps + r.move_bps == pytest.approx(r.overshoot_bps)
            assert r.jump_bps == pytest.approx(max((abs(100 / r.p_open - 1) - GAMMA) * 1e4, 0))
        else:
            assert r.jump_bps is None and r.move_bps is None


def test_blocks_waited(spark):
    blocks = spark.createDataFrame([(n, 1_000 * n) for n in range(1, 11)], "number bigint, milli_ts bigint")
    opened = spark.createDataFrame([(9, 9_000, 6_500), (9, 9_000, 7_000), (9, 9_000, 9_000), (9, 9_000, -1)], "block bigint, ts_ms bigint, t_open bigint")
    got = {r.t_open: (r.k_blocks, r.tau_lo_ms) for r in blocks_waited(opened, blocks).collect()}
    assert got == {6_500: (3, 1_500), 7_000: (2, 1_000), 9_000: (0, -1_000), -1: (0, -1)}


def test_ranges_match_brute_force(spark):
    import random

    rng = random.Random(11)
    ticks = [(t, 100 + rng.gauss(0, 2)) for t in sorted(rng.sample(range(1, 3_000_000), 700))]
    times = sorted(rng.sample(range(1, 3_000_000), 80))
    arbs = [("p", 100.0, GAMMA, i, 0, t, times[i - 1] if i else 0, 0.0, 0.0, 0.02) for i, t in enumerate(times)]
    a = spark.createDataFrame(arbs, "pool string, p_pre double, fee_rate double, " + ARB)
    tk = spark.createDataFrame([("s", *t) for t in ticks], "symbol string, ts_ms bigint, price double")
    pools = spark.createDataFrame([("p", "s")], "pool string, symbol string")
    for bounded in (True, False):
        got = {r.block: (r.first_ts, r.cross_ts) for r in last_inside_band(a, tk, pools, SEARCH, bounded=bounded).collect()}
        for _, p, g, block, _, t, prev, *_ in arbs:
            span = [(i, x) for i, x in enumerate(ticks) if max(prev, t - SEARCH) < x[0] <= t]
            if not span:
                assert block not in got
                continue
            inside = [i for i, x in span if p / (1 + g) <= x[1] <= p / (1 - g)]
            cross = ticks[min(inside[-1] + 1, len(ticks) - 1)][0] if inside else None
            assert got[block] == (span[0][1][0], cross)
