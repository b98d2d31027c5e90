"""Components, operators, log decoding, parsing, concentration."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import clock, hexwords, pricing, text
from tideline.operators.graph import connected_components
from tideline.operators.ranking import concentration, quantile_bins, sample_per_group
from tideline.plans import operators as op


def brute(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("kind", ["path", "hub", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "path": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)],
        "hub": [("hub", f"w{i}") for i in range(300)] + [("x", "y")],
        "random": [(f"n{rng.randrange(150)}", f"m{rng.randrange(150)}") for _ in range(120)],
        "loops": [("a", "a"), ("b", "c"), ("c", "b")],
    }[kind]
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r.member: r.component for r in connected_components(df, "a", "b").collect()} == brute(edges)


def test_components_keep_short_plans_and_true_sizes(spark):
    """However many rounds: no joins are left in the result's plan, and its size is that of its rows, not of products of rounds."""
    edges = [(i, i + 1) for i in range(3_000)]
    parts = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    plan = parts._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString() and int(plan.stats().sizeInBytes()) < 10**7
    assert parts.filter("component = 0").count() == 3_001


def test_operators_with_a_public_router(spark):
    rows = [("pool", s, w, s) for s, w, n in [
        ("c1", "w1", 3), ("c1", "w2", 2), ("c2", "w2", 4),  # c1, c2, w1, w2: one operator
        ("c3", "w9", 2),  # its own operator
        ("hub", "w1", 1), ("hub", "w7", 5), *[("hub", f"z{i}", 1) for i in range(6)],  # public router
    ] for _ in range(n)] + [("pool", "hub", None, None), ("pool", "c4", None, None)]
    arbs = spark.createDataFrame(rows, "pool string, sender string, tx_from string, tx_to string")
    contracts = op.contract_table(arbs, 5, 2.0)
    assert [r.sender for r in contracts.filter("public").collect()] == ["hub"]
    labelled, table = op.with_operators(arbs, contracts, 3)
    got = {(r.sender, r.tx_from): r.operator for r in labelled.collect()}
    assert got[("c1", "w1")] == got[("c2", "w2")] == got[("hub", "w1")] == "c:c1"
    assert got[("c3", "w9")] == "c:c3" and got[("c4", None)] == "c:c4"
    assert got[("hub", "w7")] == "e:w7" and got[("hub", "z0")] == "anon" and got[("hub", None)] == "anon"
    assert {(r.operator, r.contracts, r.wallets, r.arbs) for r in table.collect()} == {("c:c1", 2, 2, 9), ("c:c3", 1, 1, 2)}


WORDS = [0, 1, 2**128, -1, -(2**255), 2**96, 2**255 - 1, -12345678901234567890]


def test_hex_words(spark):
    rows = [(str(v), f"{v % 2**256:064x}") for v in WORDS]
    df = spark.createDataFrame(rows, "v string, w string")
    out = df.select("v", "w", hexwords.signed_double(F.col("w")).alias("s"), hexwords.unsigned_double(F.col("w")).alias("u"), hexwords.decimal_string(F.col("w"), True).alias("t")).collect()
    for r in out:
        assert r.t == r.v
        assert r.s == pytest.approx(float(int(r.v)), rel=1e-15)
        assert r.u == pytest.approx(float(int(r.w, 16)), rel=1e-15)


def test_price_from_square_root(spark):
    root = int((3.5**0.5) * 2**96)
    df = spark.createDataFrame([(str(root), 18, 18)], "x string, d0 int, d1 int")
    price = lambda b: pricing.pool_price(pricing.number_from_text(F.col("x")), F.col("d0"), F.col("d1"), F.lit(b))
    r = df.select(price(True).alias("a"), price(False).alias("b")).first()
    assert r.a == pytest.approx(3.5) and r.b == pytest.approx(1 / 3.5)


def test_trade_metrics_by_hand(spark):
    df = spark.createDataFrame([(101.0, 100.2, 100.0, 2.0, -200.5, 0.005)], "p_pre double, p_post double, p_cex double, dB double, dQ double, fee_rate double")
    r = pricing.with_trade_metrics(df).first()
    assert r.is_arb and r.is_arb_strict and r.volume_q == pytest.approx(200) and r.fee_income == pytest.approx(1.0)
    assert r.lp_gain == pytest.approx(-0.5) and r.arb_loss == pytest.approx(1.5)


def test_clock(spark):
    df = spark.createDataFrame([(1_705_363_200_123,)], "t bigint")
    r = df.select(clock.hour_of_day(F.col("t")).alias("h"), clock.day_of_week(F.col("t")).alias("d"), clock.utc_date(F.col("t")).alias("u")).first()
    assert (r.h, r.d, str(r.u)) == (0, 1, "2024-01-16")


def test_printed_cells(spark):
    df = spark.createDataFrame([("−0.110*** (0.041)",), ("0.25 (0.1)",), ("—",)], "c string")
    got = [(r.b, r.s) for r in df.select(text.estimate_of(F.col("c")).alias("b"), text.stderr_of(F.col("c")).alias("s")).collect()]
    assert got == [(-0.11, 0.041), (0.25, 0.1), (None, None)]


def test_concentration_by_hand(spark):
    counts = [50, 20, 20, 5, 5]
    df = spark.createDataFrame([("g", f"s{i}", n) for i, n in enumerate(counts)], "g string, s string, n bigint")
    r = concentration(df, ["g"], active=20).first()
    assert (r.n_members, r.n_total, r.n_for_90pct, r.n_active) == (5, 100, 3, 3)
    assert r.hhi_count == pytest.approx(sum((n / 100) ** 2 for n in counts)) and (r.top1_share, r.top3_share, r.top5_share) == (0.5, 0.9, 1.0)


def test_terciles_use_interpolated_edges(spark):
    df = spark.createDataFrame([("p", float(v)) for v in range(1, 8)], "pool string, v double")
    got = {r.v: r.b for r in quantile_bins(df, ["pool"], "v", 3, "b").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2}


def test_sample_is_reproducible(spark):
    df = spark.createDataFrame([(f"p{i % 3}", i) for i in range(300)], "pool string, id bigint")
    draw = lambda d: sorted(map(tuple, sample_per_group(d, ["pool"], ["id"], 10, 1).collect()))
    assert draw(df) == draw(df.repartition(7)) and len(draw(df)) == 30
