"""Readers for landed files: declared schemas, absent optional columns filled with NULL, keys taken from paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.functions import clock, hexwords, text
from tideline.schemas import CHANGES, EVENT_LOG

# Column orders of the exchange's daily files and the event-log record.
CANDLE_FILE = "open_time open high low close volume close_time quote_volume n_trades taker_buy_base taker_buy_quote ignored"
TRADE_FILE = "agg_id price qty first_id last_id ts_ms is_buyer_maker is_best_match"


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Parquet with a declared schema: columns a file lacks come back NULL, and only the wanted ones are read."""
    return spark.read.schema(schema).parquet(path).select(*(columns or schema.names))


def with_file_stem(df: DataFrame, name: str = "pool") -> DataFrame:
    """Adds the stem of the source file, e.g. the pool a per-pool file belongs to."""
    return df.withColumn(name, text.file_stem(F.col("_metadata.file_path")))


def _headerless(spark: SparkSession, path: str, names: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names.split()])
    return spark.read.schema(schema).csv(path)


def read_candles(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Daily candle files, with or without a header line, in milli- or microseconds."""
    raw = _headerless(spark, path, CANDLE_FILE).withColumn("_t", F.col("open_time").try_cast("bigint")).filter("_t IS NOT NULL")
    return raw.select(
        F.lit(symbol).alias("symbol"), clock.normalised_epoch(F.col("_t")).alias("ts_ms"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("n_trades").cast("bigint").alias("n_trades"), F.col("taker_buy_base").cast("double").alias("taker_buy_base"),
    )


def read_trades(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Daily trade files; the trade id is kept because it orders trades inside a millisecond."""
    raw = _headerless(spark, path, TRADE_FILE).withColumn("_id", F.col("agg_id").try_cast("bigint")).filter("_id IS NOT NULL")
    return raw.select(
        F.lit(symbol).alias("symbol"), F.col("_id").alias("agg_id"), clock.normalised_epoch(F.col("ts_ms").cast("bigint")).alias("ts_ms"),
        F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"),
        (F.lower("is_buyer_maker") == "true").alias("is_buyer_maker"),
    )


def candles_with_fallback(candles: DataFrame, trades: DataFrame) -> DataFrame:
    """One-second closes; (symbol, day) pairs without candles are built from trades (last price of the second).

    Both: symbol, date; candles: ts_ms, close; trades: ts_ms, agg_id, price."""
    covered = candles.select("symbol", "date").distinct()
    missing = trades.join(covered, ["symbol", "date"], "left_anti")
    built = missing.groupBy("symbol", "date", clock.floor_ms(F.col("ts_ms"), clock.SECOND_MS).alias("ts_ms")).agg(
        F.max_by("price", F.struct("ts_ms", "agg_id")).alias("close")
    )
    return candles.select("symbol", "date", "ts_ms", "close").unionByName(built)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Landed log records (JSON lines)."""
    return spark.read.schema(EVENT_LOG).json(path)


def decode_swaps(logs: DataFrame, exact_text: bool = False) -> DataFrame:
    """Swap rows from log records. Amounts are doubles; ``exact_text`` gives lossless decimal strings instead."""
    def number(index: int, signed: bool):
        w = hexwords.word(F.col("data"), index)
        if exact_text:
            return hexwords.decimal_string(w, signed)
        return hexwords.signed_double(w) if signed else hexwords.unsigned_double(w)

    seconds = F.col("blockTimestamp")
    seven = hexwords.word_count(F.col("data")) >= 7
    return logs.select(
        hexwords.hex_to_bigint(F.col("blockNumber")).alias("block"),
        F.col("transactionHash").alias("tx"),
        hexwords.hex_to_bigint(F.col("logIndex")).alias("log_index"),
        hexwords.address_from_topic(F.col("topics")[1]).alias("sender"),
        hexwords.address_from_topic(F.col("topics")[2]).alias("recipient"),
        number(0, True).alias("amount0"), number(1, True).alias("amount1"),
        number(2, False).alias("sqrt_price_x96"), number(3, False).alias("liquidity"),
        hexwords.signed_double(hexwords.word(F.col("data"), 4)).cast("int").alias("tick"),
        F.when(seven, number(5, False)).alias("protocol_fee0"), F.when(seven, number(6, False)).alias("protocol_fee1"),
        F.when(seconds.startswith("0x"), hexwords.hex_to_bigint(seconds)).otherwise(F.coalesce(seconds.try_cast("bigint"), F.lit(-1))).alias("block_ts"),
    )


def decode_liquidity_events(logs: DataFrame, kind_column: str = "kind") -> DataFrame:
    """Mint and burn rows; a burn's liquidity delta is negative and its payload starts one word earlier."""
    mint = F.col(kind_column) == "mint"
    at = lambda i: F.when(mint, hexwords.word(F.col("data"), i + 1)).otherwise(hexwords.word(F.col("data"), i))
    tick = lambda i: hexwords.signed_double(hexwords.payload(F.col("topics")[i])).cast("int")
    delta = hexwords.unsigned_double(at(0))
    return logs.select(
        hexwords.hex_to_bigint(F.col("blockNumber")).alias("block"), F.col("transactionHash").alias("tx"), F.col(kind_column).alias("kind"),
        hexwords.address_from_topic(F.col("topics")[1]).alias("owner"), tick(2).alias("tick_lower"), tick(3).alias("tick_upper"),
        F.when(mint, delta).otherwise(-delta).alias("liquidity_delta"),
        hexwords.unsigned_double(at(1)).alias("amount0"), hexwords.unsigned_double(at(2)).alias("amount1"),
    )


def read_run_config(spark: SparkSession, path: str) -> DataFrame:
    """Change points and block intervals from a run's summary file."""
    return spark.read.schema(CHANGES).option("multiLine", True).json(path)


def read_panels(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV panels of many pools; the pool is the file name."""
    return with_file_stem(spark.read.schema(schema).option("header", True).csv(path))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case keys to leave out. The key is ``sender``, else the first column; with a ``public``
    column only its true rows count."""
    listed = spark.read.option("header", True).csv(path)
    key = "sender" if "sender" in listed.columns else listed.columns[0]
    if "public" in listed.columns:
        listed = listed.filter(F.lower(F.trim("public")).isin("true", "1"))
    return listed.select(F.lower(F.col(key)).alias("sender")).filter("sender IS NOT NULL").distinct()


def without_members(df: DataFrame, excluded: DataFrame, key: str = "sender") -> DataFrame:
    """Rows whose key (any case) is not excluded. Catalyst broadcasts the list when it is small enough."""
    renamed = excluded.select(F.col("sender").alias("_x"))
    return df.join(renamed, F.lower(F.col(key)) == F.col("_x"), "left_anti")
