"""Scans, scalar functions, filters, block tables, set operations and star-schema joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import market as m
from checks.market import table, with_parts
from checks.q_swaps import market_series
from checks.registry import query
from checks.rounding import rounded
from tideline.functions import clock, hexwords, pricing, text
from tideline.operators import blocks as bk
from tideline.operators.episodes import coverage_gaps, episodes, half_life, log_returns
from tideline.operators.ordered import previous_row
from tideline.operators.quantiles import Quantile, summarise
from tideline.operators.ranking import sample_per_group
from tideline.plans import enrich, regime as rg
from tideline.schemas import CHANGES
from tideline.sources import readers


# ------------------------------------------------------------------------------------------------------------------ scans
@query("scan_pruned", "SELECT l_returnflag, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1")
def scan_pruned(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))


@query("scan_glob_path_cols", "SELECT 'nation' AS pool, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def scan_glob_path_cols(spark, sf):
    scans = [readers.with_file_stem(table(spark, sf, name)).select("pool") for name in ("nation", "region")]
    return scans[0].unionByName(scans[1]).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("scan_partitioned", "SELECT l_shipdate::DATE AS day, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")
def scan_partitioned(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price"))
    return rounded(d, 2)


@query("candles_with_trade_fallback", with_parts("""
    SELECT event_type AS symbol, ts_ms, close FROM (
      SELECT event_type, (ts_ms // 60000) * 60000 AS ts_ms, arg_max(value, (ts_ms, event_id)) AS close, (min(ts_ms) // 86400000) % 3 AS d FROM ev GROUP BY 1, 2) WHERE d <> 0
    UNION ALL
    SELECT event_type, (ts_ms // 1000) * 1000, arg_max(value, (ts_ms, event_id)) FROM ev WHERE (ts_ms // 86400000) % 3 = 0 GROUP BY 1, 2""", "ev"))
def candles_with_trade_fallback(spark, sf):
    trades = m.events(spark, sf).select(F.col("event_type").alias("symbol"), clock.utc_date(F.col("ts_ms")).alias("date"), "ts_ms", F.col("event_id").alias("agg_id"), F.col("value").alias("price"))
    candle = trades.groupBy("symbol", "date", clock.floor_ms(F.col("ts_ms"), clock.MINUTE_MS).alias("minute")).agg(F.max_by("price", F.struct("ts_ms", "agg_id")).alias("close"))
    present = candle.filter(F.pmod(F.floor(F.col("minute") / clock.DAY_MS), F.lit(3)) != 0).withColumnRenamed("minute", "ts_ms")
    return readers.candles_with_fallback(present, trades).select("symbol", "ts_ms", "close")


GAPS_SQL = with_parts("""
    SELECT pool, gap_start, gap_stop FROM (
      SELECT pool, reached + 1 AS gap_start, least(coalesce(nxt - 1, hi), hi) AS gap_stop FROM (
        SELECT pool, hi, start, max(stop) OVER (PARTITION BY pool ORDER BY start ROWS UNBOUNDED PRECEDING) AS reached, lead(start) OVER (PARTITION BY pool ORDER BY start) AS nxt
        FROM (SELECT pool, lo, hi, start, max(stop) AS stop FROM (
                SELECT s.pool, b.lo, b.hi, s.block AS start, s.block + 2 + s.log_index % 40 AS stop FROM sw s, (SELECT min(number) AS lo, max(number) AS hi FROM bl) b
                UNION ALL SELECT DISTINCT s.pool, b.lo, b.hi, b.lo - 1, b.lo - 1 FROM sw s, (SELECT min(number) AS lo, max(number) AS hi FROM bl) b) GROUP BY 1, 2, 3, 4)))
    WHERE gap_start <= gap_stop""", "sw", "bl")


def _gaps(spark, sf, bounded):
    span = m.blocks(spark, sf).agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    done = m.swaps(spark, sf).select("pool", F.col("block").alias("start"), (F.col("block") + 2 + F.pmod("log_index", F.lit(40))).alias("stop")).crossJoin(F.broadcast(span))
    return coverage_gaps(done, ["pool"], "lo", "hi", bounded=bounded)


@query("coverage_gaps", GAPS_SQL)
def coverage_gaps_query(spark, sf):
    return _gaps(spark, sf, None)


@query("coverage_gaps_sliced", GAPS_SQL)
def coverage_gaps_sliced(spark, sf):
    return _gaps(spark, sf, False)


@query("sample_per_group")
def sample_query(spark, sf):
    return sample_per_group(m.swaps(spark, sf), ["pool"], ["block", "log_index"], 50, seed=7).select("pool", "block", "log_index", "p_post")


# ------------------------------------------------------------------------------------------------------ scalar functions
@query("decode_hex_words", """
    SELECT event_id, CAST(event_id AS DOUBLE) AS positive, -CAST(event_id AS DOUBLE) AS negative, 2 AS n_words, CAST(event_id AS DOUBLE) * 4503599627370496.0 AS shifted FROM events""")
def decode_hex_words(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    body = F.lower(F.hex("event_id"))
    plus = F.lpad(body, 64, "0")
    minus = F.when(F.col("event_id") == 0, F.lpad(F.lit("0"), 64, "0")).otherwise(F.lpad(F.lower(F.hex(-F.col("event_id"))), 64, "f"))
    e = e.withColumn("data", F.concat(F.lit("0x"), plus, minus))
    return e.select(
        "event_id", hexwords.unsigned_double(hexwords.word(F.col("data"), 0)).alias("positive"), hexwords.signed_double(hexwords.word(F.col("data"), 1)).alias("negative"),
        hexwords.word_count(F.col("data")).alias("n_words"), hexwords.unsigned_double(F.lpad(F.concat(body, F.lit("0" * 13)), 64, "0")).alias("shifted"))


@query("decode_hex_text", "SELECT event_id, CAST(event_id AS VARCHAR) AS positive, CAST(-event_id AS VARCHAR) AS negative FROM events")
def decode_hex_text(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    plus = F.lpad(F.lower(F.hex("event_id")), 64, "0")
    minus = F.when(F.col("event_id") == 0, F.lpad(F.lit("0"), 64, "0")).otherwise(F.lpad(F.lower(F.hex(-F.col("event_id"))), 64, "f"))
    return e.select("event_id", hexwords.decimal_string(plus, False).alias("positive"), hexwords.decimal_string(minus, True).alias("negative"))


@query("table_function", "SELECT event_id, CAST(i AS INTEGER) AS position, CAST(CASE i WHEN 0 THEN event_id ELSE user_id END AS DOUBLE) AS value FROM events, (VALUES (0), (1)) v(i)")
def decode_words_table(spark, sf):
    e = table(spark, sf, "events").withColumn("data", F.concat(F.lit("0x"), F.lpad(F.hex("event_id"), 64, "0"), F.lpad(F.hex("user_id"), 64, "0")))
    rows = e.select("event_id", F.posexplode(hexwords.words(F.col("data"))).alias("position", "w"))
    return rows.select("event_id", "position", hexwords.unsigned_double(F.col("w")).alias("value"))


@query("topic_address", "SELECT user_id, '0x' || lpad(lower(to_hex(user_id)), 64, '0') AS topic, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS address FROM events GROUP BY user_id")
def topic_address(spark, sf):
    e = table(spark, sf, "events").select("user_id").distinct()
    topic = hexwords.topic_from_address(F.concat(F.lit("0x"), F.hex("user_id")))
    return e.select("user_id", topic.alias("topic"), hexwords.address_from_topic(topic).alias("address"))


@query("bigint_string_to_double", "SELECT event_id, CAST(event_id::VARCHAR || '000000000000000000000000' AS DOUBLE) AS v FROM events")
def bigint_string_to_double(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    return e.select("event_id", pricing.number_from_text(F.concat(F.col("event_id").cast("string"), F.lit("0" * 24))).alias("v"))


@query("sqrt_price_to_price", with_parts("""
    SELECT event_id, round(value * value, 6) AS as_token0, round(1.0::DOUBLE / (value * value), 6) AS as_token1, round(value * value * 1000, 6) AS decimals FROM ev""", "ev"))
def sqrt_price_to_price(spark, sf):
    e = m.events(spark, sf)
    x = F.col("value") * pricing.SQRT_PRICE_SCALE
    return rounded(e.select(
        "event_id", pricing.pool_price(x, F.lit(18), F.lit(18), F.lit(True)).alias("as_token0"), pricing.pool_price(x, F.lit(18), F.lit(18), F.lit(False)).alias("as_token1"),
        pricing.pool_price(x, F.lit(9), F.lit(6), F.lit(True)).alias("decimals")))


@query("orient_flows", with_parts("""
    SELECT event_id, round(CASE WHEN event_type = 'view' THEN k ELSE value END / 100.0::DOUBLE, 8) AS base, round(CASE WHEN event_type = 'view' THEN value ELSE k END / 100.0::DOUBLE, 8) AS quote, round(k / 1000000.0::DOUBLE, 8) AS fee_rate FROM ev""", "ev"))
def orient_flows(spark, sf):
    e = m.events(spark, sf)
    base, quote = pricing.oriented(F.col("value"), F.col("k"), F.lit(2), F.lit(2), F.col("event_type") != "view")
    return rounded(e.select("event_id", base.alias("base"), quote.alias("quote"), pricing.fee_rate(F.col("k")).alias("fee_rate")), 8)


@query("time_floors", with_parts(f"""
    SELECT event_id, (ts_ms // 1000) * 1000 AS s, (ts_ms // 60000) * 60000 AS mi, (ts_ms // 3600000) * 3600000 AS h, (ts_ms // 86400000) * 86400000 AS d,
           CAST(extract(hour FROM make_timestamp(ts_ms * 1000)) AS INTEGER) AS hod, CAST(extract(isodow FROM make_timestamp(ts_ms * 1000)) - 1 AS INTEGER) AS dow,
           CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day, round((ts_ms - {m.CHANGE_MS}) / 86400000.0::DOUBLE, 8) AS t_days, CAST(floor((ts_ms - {m.CHANGE_MS}) / 86400000.0::DOUBLE) AS INTEGER) AS dayrel FROM ev""", "ev"))
def time_floors(spark, sf):
    t = F.col("ts_ms")
    return rounded(m.events(spark, sf).select(
        "event_id", *[clock.floor_ms(t, step).alias(n) for n, step in (("s", clock.SECOND_MS), ("mi", clock.MINUTE_MS), ("h", clock.HOUR_MS), ("d", clock.DAY_MS))],
        clock.hour_of_day(t).alias("hod"), clock.day_of_week(t).alias("dow"), clock.utc_date(t).alias("day"),
        clock.days_since(t, m.CHANGE_MS).alias("t_days"), clock.relative_day(t, m.CHANGE_MS).alias("dayrel")), 8)


@query("header_ms_timestamp", "SELECT event_id, event_id * 1000 + CASE WHEN user_id * 37 % 65536 < 1000 THEN user_id * 37 % 65536 ELSE 0 END AS milli_ts FROM events")
def header_ms_timestamp(spark, sf):
    mix = F.concat(F.lit("0x"), F.lpad(F.hex(F.pmod(F.col("user_id") * 37, F.lit(65536))), 64, "0"))
    return table(spark, sf, "events").select("event_id", clock.header_ms(F.col("event_id"), mix).alias("milli_ts"))


@query("normalise_epoch_unit", with_parts("SELECT event_id, ts_ms FROM ev", "ev"))
def normalise_epoch_unit(spark, sf):
    mixed = F.when(F.col("event_id") % 2 == 0, F.col("ts_ms")).otherwise(F.col("ts_ms") * 1000 + 321)
    return m.events(spark, sf).select("event_id", clock.normalised_epoch(mixed).alias("ts_ms"))


@query("parse_estimate_cell", "SELECT event_id, round(-value, 2) AS b, round(user_id / 1000.0::DOUBLE, 3) AS se FROM events")
def parse_estimate_cell(spark, sf):
    e = table(spark, sf, "events")
    sign = F.when(F.col("event_id") % 2 == 0, "−").otherwise("-")
    cell = F.concat(sign, F.format_string("%.2f", "value"), F.repeat(F.lit("*"), F.pmod("event_id", F.lit(4)).cast("int")), F.lit(" ("), F.format_string("%.3f", F.col("user_id") / 1000.0), F.lit(")"))
    parsed = e.select("event_id", cell.alias("cell")).select("event_id", text.estimate_of(F.col("cell")).alias("b"), text.stderr_of(F.col("cell")).alias("se"))
    return parsed.select("event_id", *[F.round(F.col(c) + 0.0137 * 10.0**-d, d).alias(c) for c, d in (("b", 2), ("se", 3))])


@query("parse_path_tokens", "SELECT event_id, event_type AS pool, event_id AS first_block, event_id + 249999 AS last_block FROM events")
def parse_path_tokens(spark, sf):
    e = table(spark, sf, "events")
    path = F.concat(F.lit("/data/raw/"), F.col("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit("_"), (F.col("event_id") + 249_999).cast("string"), F.lit(".parquet"))
    pool, first, last = text.path_parts(path)
    return e.select("event_id", pool.alias("pool"), first.alias("first_block"), last.alias("last_block"))


@query("significance_stars", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN '***' WHEN l_discount < 0.05 THEN '**' WHEN l_discount < 0.1 THEN '*' ELSE '' END AS mark FROM lineitem")
def significance_stars(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.stars(F.col("l_discount")).alias("mark"))


@query("json_props", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("nominal_elapsed", with_parts(f"""
    SELECT log_index, greatest(0, least(block, {m.CHANGE_BLOCK}) - (block - log_index % 5000)) * 1500 + (log_index % 5000 - greatest(0, least(block, {m.CHANGE_BLOCK}) - (block - log_index % 5000))) * 750 AS ms FROM sw""", "sw"))
def nominal_elapsed(spark, sf):
    s = m.swaps(spark, sf)
    start = F.col("block") - F.pmod("log_index", F.lit(5000))
    return s.select("log_index", clock.nominal_elapsed(start, F.col("block"), m.CHANGE_BLOCK, 1500, 750).alias("ms"))


@query("law_and_elasticity", f"""
    SELECT event_type, round(0.5 * ln(45.0::DOUBLE / 60), 8) AS law, round(b / ln(45.0::DOUBLE / 60), 8) AS elasticity, round(b / (0.5 * ln(45.0::DOUBLE / 60)), 8) AS share_of_law
    FROM (SELECT event_type, regr_slope(value, user_id) AS b FROM events GROUP BY 1)""")
def law_and_elasticity(spark, sf):
    from tideline.plans import estimates as es

    slopes = table(spark, sf, "events").groupBy("event_type").agg(F.regr_slope("value", "user_id").alias("b")).withColumn("change", F.lit("c"))
    dims = slopes.groupBy("change").agg(F.lit(m.DT_PRE_MS / 1000).alias("dt_pre"), F.lit(m.DT_POST_MS / 1000).alias("dt_post"))
    return rounded(es.law_and_elasticity(slopes, dims).select("event_type", "law", "elasticity", "share_of_law"), 8)


# ---------------------------------------------------------------------------------------------------------------- filters
@query("window_halfopen", with_parts("SELECT pool, count(*) AS n, min(hour_ms) AS first_hour, max(hour_ms) AS last_hour FROM pn WHERE t_days >= -7 AND t_days < 7 GROUP BY pool", "pn"))
def window_halfopen(spark, sf):
    return m.panel(spark, sf).filter("t_days >= -7 AND t_days < 7").groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.min("hour_ms").alias("first_hour"), F.max("hour_ms").alias("last_hour"))


@query("clean_positive", with_parts("SELECT pool, count(*) AS n FROM pn WHERE overshoot_bps > 0 AND sigma_ps > 0 AND liq_mean > 0 AND volume > 0 GROUP BY pool", "pn"))
def clean_positive(spark, sf):
    from tideline.plans import estimates as es

    return es.clean_positive(m.panel(spark, sf), "overshoot_bps").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("predicate_string", with_parts("SELECT pool, hour_ms, n_arb FROM pn WHERE arb_profit > 0 AND n_arb >= 2", "pn"))
def predicate_string(spark, sf):
    return m.panel(spark, sf).filter(F.expr("arb_profit > 0 AND n_arb >= 2")).select("pool", "hour_ms", "n_arb")


@query("exclude_members", with_parts("SELECT pool, count(*) AS n FROM sw WHERE sender NOT IN (SELECT sender FROM sw GROUP BY sender HAVING count(*) >= 75) GROUP BY pool", "sw"))
def exclude_members(spark, sf):
    s = m.swaps(spark, sf)
    busy = s.groupBy("sender").agg(F.count(F.lit(1)).alias("n")).filter("n >= 75").select(F.lower("sender").alias("sender"))
    shouted = s.withColumn("sender", F.upper("sender"))
    return readers.without_members(shouted, busy).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("min_count_groups", with_parts("SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, count(*) AS n FROM sw GROUP BY 1, 2 HAVING count(*) >= 5", "sw"))
def min_count_groups(spark, sf):
    return m.swaps(spark, sf).groupBy("pool", clock.floor_ms(F.col("ts_ms"), clock.HOUR_MS).alias("hour_ms")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


# ------------------------------------------------------------------------------------------------------------------ joins
@query("tx_join", with_parts("""
    SELECT s.pool, count(*) AS n, round(avg(CASE WHEN t.tx_from IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 8) AS coverage
    FROM sw s LEFT JOIN (SELECT block, log_index, tx_from FROM sw WHERE log_index % 10 <> 0) t USING (block, log_index) GROUP BY 1""", "sw"))
def tx_join(spark, sf):
    from tideline.plans import operators as op

    s = m.swaps(spark, sf)
    tx = s.filter("log_index % 10 <> 0").select("block", "log_index", "tx_from")
    return rounded(op.transaction_coverage(op.with_transactions(s.drop("tx_from"), tx), ["pool"]), 8)


@query("recover_attribute", with_parts("SELECT block, log_index, sender FROM sw WHERE log_index % 3 = 0", "sw"))
def recover_attribute(spark, sf):
    from tideline.plans import operators as op

    s = m.swaps(spark, sf)
    keys = s.filter("log_index % 3 = 0").select("block", "log_index")
    return op.recover_attribute(keys, s, ["block", "log_index"], "sender")


@query("dim_regime_join", with_parts(f"""
    SELECT pool, CASE WHEN block >= {m.CHANGE_BLOCK} THEN 'post' ELSE 'pre' END AS regime, CASE WHEN block >= {m.CHANGE_BLOCK} THEN 45.0::DOUBLE ELSE 60.0::DOUBLE END AS dt, count(*) AS n FROM sw GROUP BY ALL""", "sw"))
def dim_regime_join(spark, sf):
    s = m.swaps(spark, sf).withColumn("change", F.lit("c"))
    dims = spark.createDataFrame([("c", m.CHANGE_BLOCK, m.CHANGE_MS, m.DT_PRE_MS / 1000, m.DT_POST_MS / 1000)], CHANGES)
    post = F.col("block") >= F.col("change_block")
    j = s.join(F.broadcast(dims), "change")
    return j.groupBy("pool", F.when(post, "post").otherwise("pre").alias("regime"), F.when(post, F.col("dt_post")).otherwise(F.col("dt_pre")).alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@query("source_diff", with_parts("""
    SELECT coalesce(a.log_index, b.log_index) AS log_index, CASE WHEN a.log_index IS NULL THEN 'only_second' WHEN b.log_index IS NULL THEN 'only_first' ELSE 'different' END AS status
    FROM (SELECT block, log_index, p_post FROM sw WHERE log_index % 50 <> 1) a
    FULL JOIN (SELECT block, log_index, CASE WHEN log_index % 70 = 3 THEN p_post + 1 ELSE p_post END AS p_post FROM sw WHERE log_index % 50 <> 2) b USING (block, log_index)
    WHERE a.log_index IS NULL OR b.log_index IS NULL OR a.p_post IS DISTINCT FROM b.p_post""", "sw"))
def source_diff(spark, sf):
    from tideline.plans import audit

    s = m.swaps(spark, sf).select("block", "log_index", "p_post")
    first = s.filter("log_index % 50 <> 1")
    second = s.filter("log_index % 50 <> 2").withColumn("p_post", F.when(F.col("log_index") % 70 == 3, F.col("p_post") + 1).otherwise(F.col("p_post")))
    return audit.source_diff(first, second, ["block", "log_index"], ["p_post"]).select("log_index", "status")


@query("timestamp_crosscheck", with_parts("SELECT count(*) AS n, count(*) FILTER (log_index % 11 = 0) AS mismatches FROM sw", "sw"))
def timestamp_crosscheck(spark, sf):
    from tideline.plans import audit

    s = m.swaps(spark, sf).withColumn("block_ts", F.floor(F.col("ts_ms") / 1000) + F.when(F.col("log_index") % 11 == 0, 1).otherwise(0))
    return audit.timestamp_crosscheck(s, m.blocks(spark, sf))


# ----------------------------------------------------------------------------------------------------------- block tables
m.PARTS["eb"] = (("ev",), "SELECT event_id AS number, ts_ms AS milli_ts, value, k FROM ev")
m.PARTS["ei"] = (("eb",), "SELECT *, CASE WHEN number - lag(number) OVER (ORDER BY number) = 1 THEN (milli_ts - lag(milli_ts) OVER (ORDER BY number)) / 1000.0::DOUBLE END AS interval FROM eb")


def event_blocks(spark, sf):
    """A block table with irregular intervals: one block per event, numbered by event id."""
    return m.events(spark, sf).select(F.col("event_id").alias("number"), F.col("ts_ms").alias("milli_ts"), F.col("value").alias("gas_used"), F.col("k").alias("gas_limit"))


def _interval_threshold(spark, sf):
    blocks = event_blocks(spark, sf)
    return blocks.agg(((F.max("milli_ts") - F.min("milli_ts")) / 1000.0 / F.count(F.lit(1)) * 0.9).alias("_limit_value"))


@query("block_intervals", with_parts("SELECT number, round(interval, 6) AS interval FROM ei", "ei"))
def block_intervals(spark, sf):
    doubled = event_blocks(spark, sf).unionByName(event_blocks(spark, sf).filter("number % 3 = 0"))
    return rounded(bk.with_intervals(bk.one_per_number(doubled)).select("number", "interval"))


@query("block_intervals_sliced", with_parts("SELECT number, round(interval, 6) AS interval FROM ei", "ei"))
def block_intervals_sliced(spark, sf):
    return rounded(bk.with_intervals(event_blocks(spark, sf), bounded=False).select("number", "interval"))


@query("detect_change_point", with_parts("""
    , lm AS (SELECT (max(milli_ts) - min(milli_ts)) / 1000.0::DOUBLE / count(*) * 0.9 AS lim FROM eb),
    ah AS (SELECT number, lim, lead(interval) OVER (ORDER BY number) AS nxt,
                  CASE WHEN count(interval) OVER a = 60 THEN avg(interval) OVER a END AS m60, CASE WHEN count(interval) OVER b = 10 THEN avg(interval) OVER b END AS m10
           FROM ei, lm WINDOW a AS (ORDER BY number ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), b AS (ORDER BY number ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))
    SELECT coarse_block, coalesce((SELECT min(number) FROM ah WHERE number >= coarse_block AND nxt < lim AND m10 < lim), coarse_block) AS change_block
    FROM (SELECT min(number) FILTER (m60 < lim) AS coarse_block FROM ah)""", "eb", "ei"))
def detect_change_point(spark, sf):
    intervals = bk.with_intervals(event_blocks(spark, sf)).crossJoin(F.broadcast(_interval_threshold(spark, sf)))
    return bk.change_point_by_column(intervals, "_limit_value")


@query("fill_block_timestamps", with_parts("""
    SELECT number, a.milli_ts + (number - a.n) * 250000 AS milli_ts, fetched FROM (
      SELECT g.number, max(e.number) OVER (ORDER BY g.number) AS n, e.number IS NOT NULL AS fetched FROM (SELECT unnest(range(min(number), max(number) + 1)) AS number FROM (SELECT * FROM eb WHERE number % 7 = 0)) g
      LEFT JOIN (SELECT * FROM eb WHERE number % 7 = 0) e ON e.number = g.number) f JOIN (SELECT number AS n, milli_ts FROM eb WHERE number % 7 = 0) a USING (n)""", "eb"))
def fill_block_timestamps(spark, sf):
    anchors = event_blocks(spark, sf).filter("number % 7 = 0")
    return bk.fill_timestamps(anchors, 10**12, 250_000, 250_000)


@query("irregular_spans", with_parts("""
    SELECT start, stop, excess_ms, excess_ms < 0 AS too_fast FROM (
      SELECT number AS start, lead(number) OVER (ORDER BY number) AS stop, lead(milli_ts) OVER (ORDER BY number) - milli_ts - (lead(number) OVER (ORDER BY number) - number) * 250000 AS excess_ms FROM eb WHERE number % 7 = 0)
    WHERE stop IS NOT NULL AND excess_ms <> 0 AND (stop - start > 1 OR excess_ms < 0)""", "eb"))
def irregular_spans(spark, sf):
    return bk.irregular_spans(event_blocks(spark, sf).filter("number % 7 = 0"), 10**12, 250_000, 250_000)


@query("refinement_requests", with_parts("""
    SELECT DISTINCT CASE WHEN stop - start - 1 <= 48 THEN unnest(range(start + 1, stop)) END AS number FROM (
      SELECT start, stop FROM (SELECT number AS start, lead(number) OVER (ORDER BY number) AS stop, lead(milli_ts) OVER (ORDER BY number) - milli_ts AS e FROM eb WHERE number % 7 = 0)
      WHERE stop - start - 1 > 0 AND stop - start - 1 <= 48 AND e - (stop - start) * 250000 > 0)
    UNION SELECT DISTINCT (start + stop) // 2 FROM (SELECT number AS start, lead(number) OVER (ORDER BY number) AS stop, lead(milli_ts) OVER (ORDER BY number) - milli_ts AS e FROM eb WHERE number % 7 = 0)
      WHERE stop - start - 1 > 48 AND e - (stop - start) * 250000 > 0""", "eb"))
def refinement_requests(spark, sf):
    return bk.refinement_requests(bk.irregular_spans(event_blocks(spark, sf).filter("number % 7 = 0"), 10**12, 250_000, 250_000))


@query("anchor_sampling", with_parts("""
    SELECT s AS run_start, unnest(range(s, least(s + 30, hi + 1))) AS number FROM (SELECT unnest(range(lo, hi + 1, 500)) AS s, hi FROM (SELECT min(number) AS lo, max(number) AS hi FROM bl))""", "bl"))
def anchor_sampling(spark, sf):
    span = m.blocks(spark, sf).agg(F.min("number").alias("a"), F.max("number").alias("b"))
    return bk.anchor_samples(span, "a", "b", 500, 30)


@query("bracket_change_point", with_parts("""
    , lm AS (SELECT (max(milli_ts) - min(milli_ts)) / 1000.0::DOUBLE / count(*) * 0.9 AS lim FROM eb),
    rn AS (SELECT number - number % 200 AS run_start, (max(milli_ts) - min(milli_ts)) / 1000.0::DOUBLE / (count(*) - 1) AS mean_interval FROM eb WHERE number % 200 < 30 GROUP BY 1 HAVING count(*) > 1),
    sl AS (SELECT *, max(CASE WHEN mean_interval >= lim THEN run_start END) OVER (ORDER BY run_start) AS last_slow FROM rn, lm)
    SELECT arg_min(last_slow, run_start) AS slow_block, min(run_start) + 30 AS fast_block FROM sl WHERE mean_interval < lim AND last_slow IS NOT NULL""", "eb"))
def bracket_change_point(spark, sf):
    runs = event_blocks(spark, sf).filter("number % 200 < 30").withColumn("run_start", F.col("number") - F.pmod("number", F.lit(200)))
    return bk.bracket_change_point_by_column(runs.crossJoin(F.broadcast(_interval_threshold(spark, sf))), "_limit_value")


@query("hourly_blocks_gas_join", with_parts("""
    SELECT hour_ms, n_blocks, round(interval_ms, 6) AS interval_ms, n_intervals, n_headers, round(gas_used, 6) AS gas_used, round(gas_limit, 6) AS gas_limit
    FROM (SELECT (milli_ts // 3600000) * 3600000 AS hour_ms, count(*) AS n_blocks, avg(interval) * 1000 AS interval_ms, count(interval) AS n_intervals FROM ei GROUP BY 1)
    LEFT JOIN (SELECT (milli_ts // 3600000) * 3600000 AS hour_ms, count(*) AS n_headers, avg(value) AS gas_used, avg(k) AS gas_limit FROM eb WHERE number % 4 = 0 GROUP BY 1) USING (hour_ms)""", "ei"))
def hourly_blocks_gas_join(spark, sf):
    b = event_blocks(spark, sf)
    return rounded(bk.hourly_blocks(bk.with_intervals(b)).join(bk.hourly_gas(b.filter("number % 4 = 0")), "hour_ms", "left"))


@query("hourly_blocks", with_parts("SELECT (milli_ts // 3600000) * 3600000 AS hour_ms, count(*) AS n_blocks, round(avg(interval) * 1000, 6) AS interval_ms, count(interval) AS n_intervals FROM ei GROUP BY 1", "ei"))
def hourly_blocks(spark, sf):
    return rounded(bk.hourly_blocks(bk.with_intervals(event_blocks(spark, sf))))


@query("first_after", with_parts(f"SELECT min(number) AS number, min(milli_ts) AS milli_ts FROM eb WHERE milli_ts >= {m.CHANGE_MS}", "eb"))
def first_after(spark, sf):
    return bk.first_at_or_after(event_blocks(spark, sf), m.CHANGE_MS)


# --------------------------------------------------------------------------------------------------------- windows, series
@query("forward_fill", with_parts("SELECT event_type, event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts_ms, event_id) AS filled FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN value END AS x FROM ev)", "ev"))
def forward_fill(spark, sf):
    from tideline.operators.ordered import carry_forward

    e = m.events(spark, sf).withColumn("x", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return carry_forward(e, ["event_type"], ["ts_ms", "event_id"], {"filled": "x"}).select("event_type", "event_id", "filled")


@query("outside_episodes", with_parts("SELECT pool, regime, length, start, stop FROM ep", "ep"))
def outside_episodes(spark, sf):
    s = market_series(spark, sf).withColumn("regime", F.when(F.col("ts_ms") < m.CHANGE_MS, "pre").otherwise("post"))
    return episodes(s, ["pool", "regime"], ["ts_ms"], F.abs("dev") > m.GAMMA, width=clock.DAY_MS).drop("run")


@query("outside_episodes_sliced", with_parts("SELECT pool, regime, length, start, stop FROM ep", "ep"))
def outside_episodes_sliced(spark, sf):
    s = market_series(spark, sf).withColumn("regime", F.when(F.col("ts_ms") < m.CHANGE_MS, "pre").otherwise("post"))
    return episodes(s, ["pool", "regime"], ["ts_ms"], F.abs("dev") > m.GAMMA, width=clock.DAY_MS, bounded=False).drop("run")


@query("log_returns", with_parts("SELECT pool, round(stddev_samp(x), 8) AS vol, count(x) AS n FROM (SELECT pool, ln(p_post) - ln(lag(p_post) OVER (PARTITION BY pool ORDER BY block, log_index)) AS x FROM sw) GROUP BY pool", "sw"))
def log_returns_query(spark, sf):
    r = log_returns(m.swaps(spark, sf), ["pool"], enrich.ORDER, "p_post", width=enrich.BLOCK_SLICE)
    return rounded(r.groupBy("pool").agg(F.stddev_samp("log_return").alias("vol"), F.count("log_return").alias("n")), 8)


@query("ar1_half_life", with_parts("SELECT pool, regime, n, round(rho, 8) AS rho, round(half_life, 6) AS half_life FROM hl", "hl"))
def ar1_half_life(spark, sf):
    s = market_series(spark, sf).withColumn("regime", F.when(F.col("ts_ms") < m.CHANGE_MS, "pre").otherwise("post"))
    h = half_life(s, ["pool", "regime"], ["ts_ms"], "dev", width=clock.DAY_MS)
    return h.select("pool", "regime", "n", F.round(F.col("rho") + 0.0137e-8, 8).alias("rho"), F.round(F.col("half_life") + 0.0137e-6, 6).alias("half_life"))


LAGS = 10
LAGGED = ["dp", "dc", "x_before", "y_before", *[f"{c}_{k}" for k in range(1, LAGS + 1) for c in ("dp", "dc")]]


@query("lagged_differences", with_parts(f"""
    SELECT pool, ts_ms, round(dp, 8) AS dp, round(dc, 8) AS dc, round(lag(x) OVER w, 8) AS x_before, round(lag(y) OVER w, 8) AS y_before,
           {", ".join(f"round(lag({c}, {k}) OVER w, 8) AS {c}_{k}" for k in range(1, LAGS + 1) for c in ("dp", "dc"))}
    FROM (SELECT pool, ts_ms, x, y, x - lag(x) OVER w AS dp, y - lag(y) OVER w AS dc
          FROM (SELECT pool, ts_ms, ln(p_pool) AS x, ln(p_cex) AS y FROM sr) WINDOW w AS (PARTITION BY pool ORDER BY ts_ms))
    WINDOW w AS (PARTITION BY pool ORDER BY ts_ms)""", "sr"))
def lagged_differences(spark, sf):
    from tideline.plans.price_discovery import lagged_changes

    s = market_series(spark, sf).withColumn("x", F.ln("p_pool")).withColumn("y", F.ln("p_cex"))
    out = lagged_changes(s, ["pool"], "ts_ms", {"dp": "x", "dc": "y"}, LAGS, step=m.STEP_MS)
    return rounded(out.select("pool", "ts_ms", *LAGGED), 8)


@query("group_median_flag", with_parts("""
    SELECT pool, hour_ms, sigma_ps > quantile_cont(sigma_ps, 0.5) OVER (PARTITION BY pool) AS high, round(ln(sigma_ps) - avg(ln(sigma_ps)) OVER (), 8) AS log_demeaned FROM pn WHERE sigma_ps > 0""", "pn"))
def group_median_flag(spark, sf):
    from tideline.plans import estimates as es

    return rounded(es.with_median_flag(m.panel(spark, sf).filter("sigma_ps > 0"), ["pool"], "sigma_ps").select("pool", "hour_ms", "high", "log_demeaned"), 8)


@query("cumulative_share", with_parts("SELECT sender, n, round(sum(n) OVER (ORDER BY n DESC, sender) / sum(n) OVER (), 8) AS share FROM (SELECT sender, count(*) AS n FROM sw GROUP BY 1)", "sw"))
def cumulative_share(spark, sf):
    from tideline.operators.ordered import running_total

    n = m.swaps(spark, sf).groupBy("sender").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1)).withColumn("_down", -F.col("n"))
    total = n.groupBy("_all").agg(F.sum("n").alias("_t"))
    run = running_total(n, ["_all"], ["_down", "sender"], {"_s": "n"}, width=1000).join(F.broadcast(total), "_all")
    return rounded(run.select("sender", "n", (F.col("_s") / F.col("_t")).alias("share")), 8)


@query("price_efficiency", with_parts("""
    SELECT e.pool, e.regime, n_episodes, round(mean_length, 6) AS mean_length, round(half_life, 6) AS half_life, outside FROM
      (SELECT pool, regime, count(*) AS n_episodes, avg(length) AS mean_length, CAST(sum(length) AS BIGINT) AS outside FROM ep GROUP BY 1, 2) e LEFT JOIN hl USING (pool, regime)""", "ep", "hl"))
def price_efficiency(spark, sf):
    s = market_series(spark, sf).withColumn("regime", F.when(F.col("ts_ms") < m.CHANGE_MS, "pre").otherwise("post"))
    keys = ["pool", "regime"]
    runs = episodes(s, keys, ["ts_ms"], F.abs("dev") > m.GAMMA, width=clock.DAY_MS).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_episodes"), F.avg("length").alias("mean_length"), F.sum("length").alias("outside"))
    return rounded(runs.join(half_life(s, keys, ["ts_ms"], "dev", width=clock.DAY_MS).select(*keys, "half_life"), keys, "left"))


# -------------------------------------------------------------------------------------------------------- order, set, shape
@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(15)


@query("canonical_order", with_parts("SELECT pool, log_index, CAST(row_number() OVER (PARTITION BY pool ORDER BY block, log_index) AS BIGINT) AS position FROM sw", "sw"))
def canonical_order(spark, sf):
    from tideline.operators.ordered import running_total

    s = m.swaps(spark, sf)
    return running_total(s, ["pool"], enrich.ORDER, {"position": F.lit(1)}, width=enrich.BLOCK_SLICE).select("pool", "log_index", "position")


@query("union_by_name", "SELECT 'c' AS kind, c_nationkey AS nation, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_nationkey, s_acctbal, s_name FROM supplier")
def union_by_name(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@query("intersect_keys", with_parts(f"SELECT sender FROM sw WHERE block < {m.CHANGE_BLOCK} INTERSECT SELECT sender FROM sw WHERE block >= {m.CHANGE_BLOCK}", "sw"))
def intersect_keys(spark, sf):
    s = m.swaps(spark, sf)
    return s.filter(F.col("block") < m.CHANGE_BLOCK).select("sender").intersect(s.filter(F.col("block") >= m.CHANGE_BLOCK).select("sender"))


@query("except_keys", with_parts("SELECT DISTINCT block FROM sw WHERE pool = 'view' AND block NOT IN (SELECT block FROM sw WHERE pool = 'click')", "sw"))
def except_keys(spark, sf):
    s = m.swaps(spark, sf)
    return s.filter("pool = 'view'").select("block").distinct().join(s.filter("pool = 'click'").select("block"), "block", "left_anti")


@query("dedup_key", with_parts("SELECT block, log_index, p_post FROM sw", "sw"))
def dedup_key(spark, sf):
    s = m.swaps(spark, sf).select("block", "log_index", "p_post")
    return s.unionByName(s.filter("log_index % 2 = 0")).groupBy("block", "log_index").agg(F.min("p_post").alias("p_post"))


@query("distinct_union_ts", with_parts("SELECT DISTINCT ts_ms FROM ev WHERE event_type IN ('view', 'click')", "ev"))
def distinct_union_ts(spark, sf):
    return m.ticks(spark, sf, "view").select("ts_ms").union(m.ticks(spark, sf, "click").select("ts_ms")).distinct()


@query("pivot_unpivot", """
    SELECT o_orderpriority AS priority, lower(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def pivot_unpivot(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    long = wide.select("priority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))
    return long.unpivot(["priority"], ["f", "o", "p"], "status", "n").filter("n IS NOT NULL")


@query("distinct_blocks", with_parts(f"SELECT pool, CASE WHEN block < {m.CHANGE_BLOCK} THEN 'pre' ELSE 'post' END AS regime, count(DISTINCT block) AS blocks_with_swap FROM en GROUP BY 1, 2", "en"))
def distinct_blocks(spark, sf):
    return rg.distinct_blocks(m.enriched_swaps(spark, sf).withColumn("regime", F.when(F.col("block") < m.CHANGE_BLOCK, "pre").otherwise("post")))


@query("reference_gap", with_parts("SELECT pool, (ts_ms // 3600000) * 3600000 AS hour_ms, round(avg(abs(p_cex_1s / p_cex - 1)) * 10000, 6) AS mean_abs_bps, round(sqrt(avg((p_cex_1s / p_cex - 1) * (p_cex_1s / p_cex - 1))) * 10000, 6) AS rms_bps FROM en GROUP BY 1, 2", "en"))
def reference_gap(spark, sf):
    from tideline.plans.panel import reference_gap as gap

    return rounded(gap(m.enriched_swaps(spark, sf)))


@query("group_lambda", with_parts("SELECT user_id, round(avg(sqrt(value)), 6) AS mean_sqrt, round(avg(CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS p_one FROM ev GROUP BY 1", "ev"))
def group_lambda(spark, sf):
    return rounded(m.events(spark, sf).groupBy("user_id").agg(F.avg(F.sqrt("value")).alias("mean_sqrt"), F.avg(F.when(F.col("k") == 1, 1.0).otherwise(0.0)).alias("p_one")))


@query("exact_quantiles_sliced", """
    SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_quantity, 0.25), 6) AS q25
    FROM lineitem GROUP BY 1, 2""")
def exact_quantiles_sliced(spark, sf):
    price = F.col("l_extendedprice")
    return rounded(summarise(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [], [Quantile("p10", price, 0.1), Quantile("p50", price, 0.5), Quantile("p90", price, 0.9), Quantile("q25", F.col("l_quantity"), 0.25)], bounded=False))
