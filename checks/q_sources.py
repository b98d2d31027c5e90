"""Sources and sinks: the given tables are written in a landing format and read back through the library."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import market as m
from checks.market import table, with_parts
from checks.registry import query
from tideline import schemas
from tideline.functions import clock
from tideline.session import scratch_folder
from tideline.sources import readers, sinks, tick_store


@query("read_market_csv", with_parts("SELECT event_type AS symbol, event_id AS agg_id, ts_ms, value AS price, event_id % 2 = 0 AS is_buyer_maker FROM ev", "ev"))
def read_market_csv(spark, sf):
    folder = scratch_folder(spark, "csv")
    e = m.events(spark, sf)
    stamp = F.when(F.col("event_id") % 3 == 0, F.col("ts_ms") * 1000).otherwise(F.col("ts_ms"))
    maker = F.when(F.col("event_id") % 2 == 0, "True").otherwise("false")
    cols = [F.col("event_id"), F.col("value"), F.lit(1.5), F.lit(1), F.lit(2), stamp, maker, F.lit("true")]
    named = e.select("event_type", *[c.cast("string").alias(n) for c, n in zip(cols, readers.TRADE_FILE.split())])
    parts = []
    for header, kind in ((True, "view"), (False, "click")):
        named.filter(F.col("event_type") == kind).drop("event_type").write.option("header", header).csv(f"{folder}/{kind}")
        parts.append(readers.read_trades(spark, f"{folder}/{kind}", kind))
    named.filter(~F.col("event_type").isin("view", "click")).write.partitionBy("event_type").csv(f"{folder}/rest")
    for kind in ("error", "purchase", "signup"):
        parts.append(readers.read_trades(spark, f"{folder}/rest/event_type={kind}", kind))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("symbol", "agg_id", "ts_ms", "price", "is_buyer_maker")


@query("tick_store", with_parts("""
    SELECT symbol, ts_ms, price FROM (SELECT event_type AS symbol, ts_ms, arg_max(value, event_id) AS price FROM ev GROUP BY 1, 2)
    WHERE ts_ms // 86400000 BETWEEN 19731 AND 19734 AND symbol IN ('view', 'click')""", "ev"))
def tick_store_query(spark, sf):
    folder = scratch_folder(spark, "ticks")
    trades = m.events(spark, sf).select(F.col("event_type").alias("symbol"), "ts_ms", F.col("event_id").alias("agg_id"), F.col("value").alias("price"))
    tick_store.write_ticks(trades, folder)
    return tick_store.read_ticks(spark, folder, date(2024, 1, 10), date(2024, 1, 12), ["view", "click"]).select("symbol", "ts_ms", "price")


def _log_rows(spark, sf):
    """Event-log records whose payload words hold the event's numbers."""
    e = m.events(spark, sf)
    w = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    minus = lambda c: F.when(c == 0, F.lpad(F.lit("0"), 64, "0")).otherwise(F.lpad(F.lower(F.hex(-c)), 64, "f"))
    cents = F.round(F.col("value") * 100).cast("bigint")
    address = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 64, "0"))
    return e.select(
        F.concat(F.lit("0x"), F.lower(F.hex(F.floor(F.col("ts_ms") / 60000).cast("bigint")))).alias("blockNumber"), F.concat(F.lit("0xt"), F.col("event_id")).alias("transactionHash"),
        F.concat(F.lit("0x"), F.lower(F.hex("event_id"))).alias("logIndex"), F.lit("0xpool").alias("address"),
        F.concat(F.lit("0x"), w(F.col("k")), minus(cents), w(cents), w(F.col("event_id")), minus(F.col("k")), w(F.col("k")), w(F.col("user_id"))).alias("data"),
        F.array(F.lit("0xtopic"), address(F.col("user_id")), address(F.col("k")), address(F.col("event_id"))).alias("topics"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(F.floor(F.col("ts_ms") / 1000).cast("bigint"))))).alias("blockTimestamp"))


@query("event_log_landing", with_parts("""
    SELECT ts_ms // 60000 AS block, event_id AS log_index, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS sender, '0x' || lpad(lower(to_hex(k)), 40, '0') AS recipient, k::DOUBLE AS amount0,
           -round(value * 100, 0)::BIGINT::DOUBLE AS amount1, round(value * 100, 0)::BIGINT::DOUBLE AS sqrt_price_x96, event_id::DOUBLE AS liquidity, CAST(-k AS INTEGER) AS tick, k::DOUBLE AS protocol_fee0,
           user_id::DOUBLE AS protocol_fee1, CASE WHEN event_id % 2 = 0 THEN ts_ms // 1000 ELSE -1 END AS block_ts FROM ev""", "ev"))
def event_log_landing(spark, sf):
    folder = scratch_folder(spark, "logs")
    _log_rows(spark, sf).write.json(folder)
    decoded = readers.decode_swaps(readers.read_event_log(spark, folder)).drop("tx")
    # -0.0 and 0.0 print differently in other engines
    return decoded.withColumn("amount1", F.col("amount1") + 0.0)


@query("decode_mint_burn", with_parts("""
    SELECT event_id AS log_index, kind, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS owner, CAST(k AS INTEGER) AS tick_lower, CAST(event_id AS INTEGER) AS tick_upper,
           CASE WHEN kind = 'mint' THEN event_id::DOUBLE ELSE -user_id::DOUBLE END AS liquidity_delta, CASE WHEN kind = 'mint' THEN user_id::DOUBLE ELSE event_id::DOUBLE END AS amount0, CASE WHEN kind = 'mint' THEN k::DOUBLE ELSE user_id::DOUBLE END AS amount1
    FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'mint' ELSE 'burn' END AS kind FROM ev)""", "ev"))
def decode_mint_burn(spark, sf):
    w = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    e = m.events(spark, sf).withColumn("kind", F.when(F.col("event_id") % 2 == 0, "mint").otherwise("burn"))
    body = F.when(F.col("kind") == "mint", F.concat(w(F.lit(7)), w(F.col("event_id")), w(F.col("user_id")), w(F.col("k")))).otherwise(F.concat(w(F.col("user_id")), w(F.col("event_id")), w(F.col("user_id"))))
    topic = lambda c: F.concat(F.lit("0x"), w(c))
    logs = e.select(
        F.lit("0x1").alias("blockNumber"), F.lit("t").alias("transactionHash"), F.concat(F.lit("0x"), F.hex("event_id")).alias("logIndex"), F.concat(F.lit("0x"), body).alias("data"), "kind",
        F.array(F.lit("0x0"), topic(F.col("user_id")), topic(F.col("k")), topic(F.col("event_id"))).alias("topics"), F.col("event_id").alias("log_index"))
    out = readers.decode_liquidity_events(logs.withColumn("transactionHash", F.col("log_index").cast("string")))
    return out.select(F.col("tx").cast("bigint").alias("log_index"), "kind", "owner", "tick_lower", "tick_upper", "liquidity_delta", "amount0", "amount1")


@query("run_config", "SELECT event_type AS change, count(*) AS change_block, max(event_id) AS change_ms, 1.5::DOUBLE AS dt_pre, 0.75::DOUBLE AS dt_post FROM events GROUP BY 1")
def run_config(spark, sf):
    folder = scratch_folder(spark, "config")
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("change")).agg(F.count(F.lit(1)).alias("change_block"), F.max("event_id").alias("change_ms"))
    e.select("*", F.lit(1.5).alias("dt_pre"), F.lit(0.75).alias("dt_post"), F.lit("x").alias("unused")).repartition("change").write.option("maxRecordsPerFile", 1).json(folder)
    return readers.read_run_config(spark, folder)


@query("scan_csv_panels", "SELECT 'part' AS source, n_name AS name, n_regionkey AS region FROM nation")
def scan_csv_panels(spark, sf):
    folder = scratch_folder(spark, "panels")
    table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.option("header", True).csv(folder)
    got = readers.read_panels(spark, folder, schemas.layout(name="string", region="bigint"))
    return got.select(F.regexp_extract("pool", "^(part)-", 1).alias("source"), "name", "region")


@query("exclusion_list", "SELECT DISTINCT lower(c_name) AS sender FROM customer WHERE c_nationkey % 2 = 0")
def exclusion_list(spark, sf):
    folder = scratch_folder(spark, "exclusions")
    flag = F.when(F.col("c_nationkey") % 2 == 0, F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("1")).otherwise("False")
    listed = table(spark, sf, "customer").select(F.upper("c_name").alias("address"), flag.alias("public"))
    listed.unionByName(listed).write.option("header", True).csv(folder)
    return readers.read_exclusions(spark, folder)


@query("append_parquet", "SELECT s_suppkey AS block, s_nationkey AS pool, NULL::DOUBLE AS price FROM supplier UNION ALL SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def append_parquet(spark, sf):
    folder = scratch_folder(spark, "append")
    layout = schemas.layout(block="bigint", price="double", pool="bigint")
    sinks.append_table(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("block"), F.col("s_nationkey").alias("pool")), folder, layout, ["pool"])
    sinks.append_table(table(spark, sf, "customer").select(F.col("c_custkey").alias("block"), F.col("c_nationkey").alias("pool"), F.col("c_acctbal").alias("price")), folder, layout, ["pool"])
    return readers.read_table(spark, folder, layout, ["block", "pool", "price"])


@query("sink_tables", "SELECT 'csv' AS fmt, count(*) AS n, sum(r_regionkey) AS keys FROM region UNION ALL SELECT 'json', count(*), sum(r_regionkey) FROM region UNION ALL SELECT 'parquet', count(*), sum(r_regionkey) FROM region")
def sink_tables(spark, sf):
    folder = scratch_folder(spark, "sinks")
    t = table(spark, sf, "region").select("r_regionkey", "r_name")
    out = None
    for fmt in ("csv", "json", "parquet"):
        sinks.write_tables({"region": t}, f"{folder}/{fmt}", fmt)
        reader = spark.read.schema(t.schema)
        back = reader.option("header", True).csv(f"{folder}/csv/region") if fmt == "csv" else reader.format(fmt).load(f"{folder}/{fmt}/region")
        row = back.groupBy(F.lit(fmt).alias("fmt")).agg(F.count(F.lit(1)).alias("n"), F.sum("r_regionkey").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


@query("replace_partitions", """
    SELECT n_nationkey AS k, n_regionkey AS pool, CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END AS v FROM nation""")
def replace_partitions(spark, sf):
    folder = scratch_folder(spark, "replace")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("pool"))
    sinks.replace_partitions(n.withColumn("v", F.lit("old")), folder, ["pool"])
    sinks.replace_partitions(n.filter("pool = 1").withColumn("v", F.lit("new")), folder, ["pool"])
    return readers.read_table(spark, folder, schemas.layout(k="bigint", v="string", pool="bigint"))
