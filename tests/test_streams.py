"""Streams delivered in several batches equal the batch operators; repeats and late rows are dropped."""

import pytest
from pyspark.sql import functions as F

from tideline.operators.blocks import change_point, with_intervals
from tideline.operators.ordered import previous_row
from tideline.schemas import layout
from tideline.streaming import carried as cr, windows as wn

SWAPS = layout(pool="string", symbol="string", block="bigint", log_index="bigint", ts_ms="bigint", p_post="double", volume_q="double", fee_income="double", arb_loss="double", is_arb="boolean", dev_pre="double")


def swap(i, pool="p", minutes=None):
    t = (i if minutes is None else minutes) * 60_000
    return (pool, "s", t // 60_000, i, t, float(i), 1.0 + i % 7, 0.1, 0.2, i % 3 == 0, 0.01 * (i % 5))


def deliver(spark, folder, batches, schema):
    """One file per batch, read oldest first."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/stage{n}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        part = next(f for f in os.listdir(f"{folder}/stage{n}") if f.startswith("part-"))
        os.rename(f"{folder}/stage{n}/{part}", f"{folder}/in/{n:03d}.parquet")
        os.utime(f"{folder}/in/{n:03d}.parquet", (time.time() - 1000 + n, time.time() - 1000 + n))
    return wn.stream_files(spark, f"{folder}/in", schema, files_per_batch=1)


def run(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_previous_state_crosses_batches(spark, tmp_path):
    batches = [[swap(i, p) for i in range(a, a + 20) for p in ("p", "q") if i % 5 or p == "p"] for a in (0, 20, 40)]
    stream = deliver(spark, str(tmp_path), batches, SWAPS)
    step = cr.previous_state_step({"p_pre": "p_post", "prev_block": "block"})
    cr.run_carried(stream, step, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    whole = previous_row(spark.createDataFrame(sum(batches, []), SWAPS), ["pool"], ["block", "log_index"], {"p_pre": "p_post", "prev_block": "block"})
    names = ["pool", "log_index", "p_pre", "prev_block"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*names).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole.select(*names).collect()))


def test_change_point_across_batches(spark, tmp_path):
    t, blocks = 0, []
    for n in range(1, 401):
        blocks.append((n, t))
        t += 1_500 if n < 200 else 750
    schema = layout(number="bigint", milli_ts="bigint")
    stream = deliver(spark, str(tmp_path), [blocks[i : i + 70] for i in range(0, 400, 70)], schema)
    cr.run_carried(stream, cr.change_point_step(1.125), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("coarse_block", "change_block").collect()]
    batch = change_point(with_intervals(spark.createDataFrame(blocks, schema)), 1.125).first()
    assert got == [(batch.coarse_block, batch.change_block)] and batch.change_block == 200


def test_late_rows_and_repeats(spark, tmp_path):
    on_time = [swap(i) for i in range(1, 201)]
    batches = [on_time[:100], on_time[80:160], on_time[160:], [swap(5, "late", minutes=5)]]
    stream = wn.deduplicated(deliver(spark, str(tmp_path), batches, SWAPS), ["pool", "block", "log_index"], "30 minutes")
    q = run(stream, str(tmp_path))
    got = sorted(r.log_index for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == list(range(1, 201)) and wn.dropped_as_late(q) == 1


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_close_behind_the_watermark(spark, tmp_path, slide):
    rows = [swap(i) for i in range(0, 400)]
    stream = wn.windowed_panel(deliver(spark, str(tmp_path), [rows[:150], rows[150:300], rows[300:]], SWAPS), slide=slide)
    run(stream, str(tmp_path))
    got = {r.hour_ms // 60_000: r.swaps for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    starts = range(-30 if slide else 0, 400, 30 if slide else 60)
    want = {s: sum(1 for i in range(400) if s <= i < s + 60) for s in starts if s + 60 <= 399 - 10}
    assert got == {s: n for s, n in want.items() if n}


def test_as_of_per_batch(spark, tmp_path):
    from tideline.operators.asof import as_of

    ticks = spark.createDataFrame([("s", t * 90_000, float(t)) for t in range(300)], "symbol string, ts_ms bigint, price double")
    batches = [[swap(i) for i in range(a, a + 50)] for a in (0, 50, 100)]
    stream = deliver(spark, str(tmp_path), batches, SWAPS)
    read = lambda s, a, b: ticks.filter(F.col("ts_ms") <= b) if a is None else ticks.filter(F.col("ts_ms").between(a, b))
    cr.run_as_of(stream, read, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    got = {r.log_index: r.p_cex for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = as_of(spark.createDataFrame(sum(batches, []), SWAPS), ticks, ["symbol"], F.col("ts_ms"), "ts_ms", {"p": "price"})
    assert got == {r.log_index: r.p for r in whole.collect()}


def test_last_tick_may_be_days_old(spark, tmp_path):
    ticks = spark.createDataFrame([("s", -10 * 86_400_000, 7.0)], "symbol string, ts_ms bigint, price double")
    stream = deliver(spark, str(tmp_path), [[swap(i) for i in range(a, a + 20)] for a in (0, 20, 40)], SWAPS)
    read = lambda s, a, b: ticks.filter(F.col("ts_ms") <= b) if a is None else ticks.filter(F.col("ts_ms").between(a, b))
    cr.run_as_of(stream, read, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    assert {r.p_cex for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {7.0}


TICKS = layout(symbol="string", ts_ms="bigint", price="double")


def test_interval_join_of_two_streams(spark, tmp_path):
    from tideline.operators.asof import as_of
    from tideline.streaming.joins import stream_as_of

    swaps = [swap(i) for i in range(1, 201)] + [(None, None, 7, 900, 50 * 60_000, 1.0, 1.0, 0.1, 0.2, False, 0.0)]
    ticks = [("s", 150_000, 9.0), ("other", 60_000, 5.0)] + [("s", t * 150_000, float(t)) for t in range(1, 80) if not 20 <= t < 30]
    left = deliver(spark, f"{tmp_path}/l", [swaps[:80][::-1] + swaps[-1:], swaps[70:140], swaps[140:-1]], SWAPS)
    right = deliver(spark, f"{tmp_path}/r", [ticks[:30], ticks[30:], [("s", 1, 99.0)]], TICKS)
    q = run(stream_as_of(left, right, 720_000, "15 minutes"), str(tmp_path))
    got = {r.log_index: (r.p_cex, r.age_ms) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for row in swaps:
        near = [(t, p) for s, t, p in ticks if s == row[1] and row[4] - 720_000 <= t <= row[4]]
        want[row[3]] = (max(near)[1], row[4] - max(near)[0]) if near else (None, None)
    assert got and {k: (v, want[k]) for k, v in got.items() if want[k] != v} == {}
    newest = min(max(r[4] for r in swaps), max(t for _, t, _ in ticks))
    due = {r[3] for r in swaps if r[4] <= newest - 900_000 - 720_000}
    assert due <= set(got) and len(got) == spark.read.parquet(f"{tmp_path}/out").count()
    assert wn.dropped_as_late(q) >= 1
    whole = as_of(spark.createDataFrame(swaps[:200], SWAPS), spark.createDataFrame(ticks, TICKS), ["symbol"], F.col("ts_ms"), "ts_ms", {"p": "price"})
    dense = {r.log_index: r.p for r in whole.collect()}
    assert all(dense[k] == p for k, (p, _) in got.items() if p is not None and k > 4)  # two ticks share the millisecond before 3 and 4


def test_dense_streams_are_joined_without_pairs(spark, tmp_path):
    """Ten times the rows in the same time: ten times the work, not a hundred times. No operator keeps rows to pair them with others."""
    from tideline.streaming.joins import stream_as_of

    big = 2**53 + 1
    rows = [("p", "s", t // 60_000, big + t, t, 1.0, 1.0, 0.1, 0.2, False, 0.0) for t in range(600_000, 603_000)]
    late = [("p", "s", 0, i, i * 600_000, 1.0, 1.0, 0.1, 0.2, False, 0.0) for i in (2, 3, 6)]
    odd = {600_500: None, 600_600: float("nan")}
    ticks = [("s", t, odd.get(t, t / 2)) for t in range(599_900, 602_900) if t % 100 != 50] + [("s", 600_601, float("nan")), ("s", 600_500, None), ("s", 9 * 600_000, 1.0)]
    left = deliver(spark, f"{tmp_path}/l", [rows[::-1], late], SWAPS)
    right = deliver(spark, f"{tmp_path}/r", [ticks[:-1], ticks[-1:]], TICKS)
    q = run(stream_as_of(left, right), str(tmp_path))
    names = {o["operatorName"] for p in q.recentProgress for o in p["stateOperators"]}
    held = max(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"])
    assert not any("join" in n.lower() for n in names) and held <= 8
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    best: dict = {}
    for _, t, p in ticks:
        best[t] = max(best.get(t, (-1, 0.0)), (0, 0.0) if p is None else (2, 0.0) if p != p else (1, p))
    for r in out:
        at = max((t for t in best if r.ts_ms - 600_000 <= t <= r.ts_ms), default=None)
        kind, price = best.get(at, (0, 0.0))
        same = (r.p_cex is None) if kind == 0 else (r.p_cex != r.p_cex) if kind == 2 else r.p_cex == price
        assert same and r.age_ms == (None if at is None else r.ts_ms - at), r
    assert {r.log_index for r in out} == {r[3] for r in rows} | {2, 3} and len(out) == 3_002


def test_hot_pool_in_any_order_is_held_by_all_tasks(spark, tmp_path):
    """Rows in any order within the delay, one pool, repeats, a restart: equal to the batch form, and no state of one pool lies in one task."""
    import shutil

    from tideline.streaming.keyed import rocksdb_state

    rows = [swap(i, "hot") for i in range(1, 400)] + [swap(7, "hot"), swap(90, "cold"), swap(310, "cold")]
    rows.sort(key=lambda r: r[3])
    batches = [rows[:150][::-1], rows[150:300][::-1], rows[300:] + [swap(3, "late", minutes=3)]]
    deliver(spark, str(tmp_path), batches, SWAPS)
    shutil.move(f"{tmp_path}/in/002.parquet", f"{tmp_path}/held.parquet")
    step = cr.previous_state_step({"p_pre": "p_post", "prev_block": "block"}, ["pool"], ["ts_ms", "log_index"], 3_600_000)
    for last in (False, True):
        if last:
            shutil.move(f"{tmp_path}/held.parquet", f"{tmp_path}/in/002.parquet")
        stream = wn.stream_files(spark, f"{tmp_path}/in", SWAPS, files_per_batch=1)
        with rocksdb_state(spark):
            q = cr.run_carried(cr.in_event_order(stream, "160 minutes"), step, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp")
            q.awaitTermination()
    assert {o["operatorName"] for p in q.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"} and wn.dropped_as_late(q) == 1
    whole = previous_row(spark.createDataFrame(rows, SWAPS), ["pool"], ["ts_ms", "log_index"], {"p_pre": "p_post", "prev_block": "block"})
    names = ["pool", "log_index", "p_post", "p_pre", "prev_block"]
    want = sorted(map(str, (tuple(r) for r in whole.select(*names).collect() if r.log_index <= 399 - 160)))
    out = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*names).collect()]
    assert sorted(map(str, out)) == want and len(out) == 399 - 160 + 2


def test_keyed_state_survives_a_restart(spark, tmp_path):
    import shutil

    from tideline.streaming.keyed import previous_in_order, rocksdb_state

    rows = [swap(i, p) for i in range(1, 120) for p in ("p", "q") if i % 5 or p == "p"]
    rows.append(("r", "s", 30, 30, 30 * 60_000, None, 1.0, 0.1, 0.2, None, None))
    rows.sort(key=lambda r: r[3])
    batches = [rows[:90][::-1], rows[90:150], rows[150:]]
    deliver(spark, str(tmp_path), batches, SWAPS)
    shutil.move(f"{tmp_path}/in/002.parquet", f"{tmp_path}/held.parquet")
    sizes = []
    for last in (False, True):
        if last:
            shutil.move(f"{tmp_path}/held.parquet", f"{tmp_path}/in/002.parquet")
        stream = wn.stream_files(spark, f"{tmp_path}/in", SWAPS, files_per_batch=1)
        with rocksdb_state(spark):
            q = run(previous_in_order(stream, ["pool"], ["block", "log_index"], {"p_pre": "p_post", "prev_block": "block"}, "15 minutes"), str(tmp_path))
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    whole = previous_row(spark.createDataFrame(rows, SWAPS), ["pool"], ["block", "log_index"], {"p_pre": "p_post", "prev_block": "block"})
    names = ["pool", "log_index", "p_post", "p_pre", "prev_block"]
    want = {(r.pool, r.log_index): tuple(r) for r in whole.select(*names).collect()}
    out = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*names).collect()]
    assert len(out) == len({r[:2] for r in out}) and all(want[r[:2]] == r for r in out)
    assert {k for k in want if k[1] <= 119 - 15} == {r[:2] for r in out}
    assert max(sizes) <= 80
