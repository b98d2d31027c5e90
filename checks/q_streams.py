"""Streaming twins run over the test tables to completion; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import table, with_parts
from checks.registry import query
from checks.rounding import rounded
from tideline.functions import clock
from tideline.operators.ordered import HOUR_MS
from tideline.session import scratch_folder
from tideline.streaming import carried as cr, windows as wn
from tideline.streaming.joins import stream_as_of
from tideline.streaming.keyed import rocksdb_state


def event_stream(spark, sf):
    """Events as a stream of swaps with simple metrics (size = value, outside when far from 50)."""
    schema = table(spark, sf, "events").schema
    e = wn.stream_files(spark, f"{sf}/events*.parquet", schema).withColumn("value", F.round(F.col("value") + F.lit(0.01), 2))
    block = F.floor(clock.epoch_ms(F.col("ts")) / 60_000).cast("bigint")
    return e.select(
        F.col("event_type").alias("pool"), F.lit("REF").alias("symbol"), block.alias("block"), F.col("event_id").alias("log_index"), clock.epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("value").alias("p_post"), F.col("value").alias("volume_q"), (F.col("value") / 100).alias("fee_income"), (F.col("value") / 50).alias("arb_loss"),
        (F.col("value") > 80).alias("is_arb"), (F.col("value") / 50 - 1).alias("dev_pre"))


def to_table(spark, stream, mode="append"):
    """Runs a stream to completion into Parquet and reads it back."""
    folder = scratch_folder(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"))
    q.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


WINDOW_AGGS = """count(*) AS swaps, round(sum(value), 6) AS volume, round(sum(value / 100), 6) AS fee_income, round(sum(value / 50), 6) AS arb_loss, count(*) FILTER (value > 80) AS n_arb,
    round(coalesce(sum(value) FILTER (value > 80), 0), 6) AS arb_volume, round(avg(abs(value / 50 - 1)), 6) AS mean_abs_dev_pre"""


@query("stream_hourly_panel", with_parts(f"""
    SELECT (ts_ms // 3600000) * 3600000 AS hour_ms, event_type AS pool, {WINDOW_AGGS} FROM ev GROUP BY 1, 2 HAVING (min(ts_ms) // 3600000 + 1) * 3600000 <= (SELECT max(ts_ms) FROM ev) - 600000""", "ev"))
def stream_hourly_panel(spark, sf):
    return rounded(to_table(spark, wn.windowed_panel(event_stream(spark, sf))))


@query("stream_sliding_panel", with_parts(f"""
    SELECT s AS hour_ms, event_type AS pool, {WINDOW_AGGS} FROM (SELECT *, unnest(range((ts_ms // 1800000) * 1800000 - 1800000, (ts_ms // 1800000) * 1800000 + 1, 1800000)) AS s FROM ev)
    GROUP BY 1, 2 HAVING s + 3600000 <= (SELECT max(ts_ms) FROM ev) - 600000""", "ev"))
def stream_sliding_panel(spark, sf):
    return rounded(to_table(spark, wn.windowed_panel(event_stream(spark, sf), slide="30 minutes")))


@query("stream_bucket_last", with_parts("""
    SELECT event_type AS pool, (ts_ms // 60000) * 60000 AS ts_ms, arg_max(value, (ts_ms, event_id)) AS p_post FROM ev GROUP BY 1, 2 HAVING (min(ts_ms) // 60000 + 1) * 60000 <= (SELECT max(ts_ms) FROM ev) - 600000""", "ev"))
def stream_bucket_last(spark, sf):
    return to_table(spark, wn.bucket_last(event_stream(spark, sf), ["pool"], "p_post", ["ts_ms", "log_index"]))


@query("stream_running_totals", with_parts(f"""
    SELECT event_type AS pool, CASE WHEN ts_ms // 60000 < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, count(*) AS swaps, round(sum(value), 6) AS volume_q, count(*) FILTER (value > 80) AS n_arb,
           round(sum(value / 100), 6) AS fee_income, round(sum(value / 50), 6) AS arb_loss, round(sum(value / 50) FILTER (value > 80), 6) AS arb_loss_arbs FROM ev GROUP BY 1, 2""", "ev"))
def stream_running_totals(spark, sf):
    return rounded(to_table(spark, wn.running_totals(event_stream(spark, sf), m.CHANGE_BLOCK), "complete"))


@query("stream_distinct_blocks", with_parts(f"""
    SELECT event_type AS pool, CASE WHEN ts_ms // 60000 < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, count(DISTINCT ts_ms // 60000) AS blocks_with_swap FROM ev GROUP BY 1, 2""", "ev"))
def stream_distinct_blocks(spark, sf):
    return to_table(spark, wn.running_blocks(event_stream(spark, sf), m.CHANGE_BLOCK), "complete")


@query("stream_episodes", with_parts("""
    SELECT event_type AS pool, count(*) AS length, min(ts_ms) AS start, max(ts_ms) AS stop FROM (
      SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts_ms) AS run
      FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY event_type ORDER BY ts_ms) AS gap FROM ev WHERE value > 80))
    GROUP BY event_type, run HAVING max(ts_ms) + 3600000 <= (SELECT max(ts_ms) FROM ev) - 600000""", "ev"))
def stream_episodes(spark, sf):
    return to_table(spark, wn.outside_sessions(event_stream(spark, sf), ["pool"], F.col("is_arb"), "1 hour"))


@query("stream_dedup_late", with_parts("SELECT event_type AS pool, ts_ms // 60000 AS block, event_id AS log_index, value AS p_post FROM ev", "ev"))
def stream_dedup(spark, sf):
    twice = event_stream(spark, sf).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return to_table(spark, wn.deduplicated(twice, ["block", "log_index"])).select("pool", "block", "log_index", "p_post")


@query("stream_prev_state", with_parts("""
    SELECT event_type AS pool, event_id AS log_index, value AS p_post, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms // 60000, event_id) AS p_pre FROM ev""", "ev"))
def stream_prev_state(spark, sf):
    folder = scratch_folder(spark, "carried")
    step = cr.previous_state_step({"p_pre": "p_post"})
    cr.run_carried(event_stream(spark, sf), step, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("pool", "log_index", "p_post", "p_pre")


@query("stream_asof", with_parts("SELECT s.event_type AS pool, s.event_id AS log_index, t.price AS p_cex FROM ev s ASOF LEFT JOIN tk t ON s.ts_ms >= t.ts_ms", "tk"))
def stream_asof(spark, sf):
    folder = scratch_folder(spark, "asof")
    read = lambda s, first, last: m.ticks(s, sf).filter((F.col("ts_ms") <= last) & (F.lit(first is None) | (F.col("ts_ms") >= F.lit(first or 0))))
    cr.run_as_of(event_stream(spark, sf), read, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("pool", "log_index", "p_cex")


@query("stream_change_point", with_parts("""
    , lm AS (SELECT 200.0::DOUBLE AS lim), ah AS (SELECT number, lim, lead(interval) OVER (ORDER BY number) AS nxt,
                  CASE WHEN count(interval) OVER a = 60 THEN avg(interval) OVER a END AS m60, CASE WHEN count(interval) OVER b = 10 THEN avg(interval) OVER b END AS m10
           FROM ei, lm WINDOW a AS (ORDER BY number ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), b AS (ORDER BY number ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
    SELECT * FROM (SELECT coarse_block, coalesce((SELECT min(number) FROM ah WHERE number >= coarse_block AND nxt < lim AND m10 < lim), coarse_block) AS change_block
    FROM (SELECT min(number) FILTER (m60 < lim) AS coarse_block FROM ah)) WHERE coarse_block IS NOT NULL""", "eb", "ei"))
def stream_change_point(spark, sf):
    folder = scratch_folder(spark, "change")
    blocks = event_stream(spark, sf).select(F.col("log_index").alias("number"), F.col("ts_ms").alias("milli_ts"))
    cr.run_carried(blocks, cr.change_point_step(200.0), f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("coarse_block", "change_block")


@query("stream_interval_join", with_parts("""
    SELECT 'REF' AS symbol, event_type AS pool, s.ts_ms // 60000 AS block, event_id AS log_index, s.ts_ms, CASE WHEN s.ts_ms - t.ts_ms <= 600000 THEN t.price END AS p_cex,
           CASE WHEN s.ts_ms - t.ts_ms <= 600000 THEN s.ts_ms - t.ts_ms END AS age_ms
    FROM ev s ASOF LEFT JOIN (SELECT ts_ms, max(value) AS price FROM ev WHERE event_type = 'view' GROUP BY 1) t ON s.ts_ms >= t.ts_ms
    WHERE s.ts_ms <= (SELECT max(ts_ms) FROM ev WHERE event_type = 'view') - 1200000""", "ev"))
def stream_interval_join(spark, sf):
    swaps = event_stream(spark, sf)
    ticks = event_stream(spark, sf).filter("pool = 'view'").select("symbol", "ts_ms", F.col("p_post").alias("price"))
    return to_table(spark, stream_as_of(swaps, ticks))


@query("stream_keyed_previous", with_parts("""
    SELECT * FROM (SELECT event_type AS pool, event_id AS log_index, value AS p_post, lag(value) OVER w AS p_pre, lag(event_id) OVER w AS prev_index, ts_ms
                   FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms, event_id))
    WHERE ts_ms <= (SELECT max(ts_ms) FROM ev) - 600000""", "ev"))
def stream_keyed_previous(spark, sf):
    rows = event_stream(spark, sf).select("pool", "log_index", "p_post", "ts_ms")
    folder = scratch_folder(spark, "keyed")
    step = cr.previous_state_step({"p_pre": "p_post", "prev_index": "log_index"}, ["pool"], ["ts_ms", "log_index"], HOUR_MS)
    with rocksdb_state(spark):
        cr.run_carried(cr.in_event_order(rows), step, f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("pool", "log_index", "p_post", "p_pre", "prev_index", "ts_ms")
