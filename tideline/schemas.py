"""Declared table layouts. Optional columns a file lacks are read as NULL, so one plan serves every file."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def layout(**columns: str) -> T.StructType:
    """StructType from name=kind pairs (kinds are single-word Spark types, ``strings`` is an array of strings)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def _named(kind: str, names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), kind)


EVENT_LOG = layout(**_named("string", "blockNumber transactionHash logIndex address data"), topics="strings", blockTimestamp="string")
SWAPS = layout(
    pool="string", block="bigint", tx="string", log_index="bigint", **_named("string", "sender recipient amount0 amount1 sqrt_price_x96 liquidity"),
    tick="int", protocol_fee0="string", protocol_fee1="string", block_ts="bigint",
)
POOLS = layout(pool="string", token0="string", token1="string", fee="int", base_is_token0="boolean", dec0="int", dec1="int", symbol="string")
BLOCKS = layout(number="bigint", milli_ts="bigint", fetched="boolean")
HEADERS = layout(**_named("bigint", "number timestamp milli_ts gas_used gas_limit"), tx_count="int", miner="string")
CANDLES = layout(symbol="string", date="date", ts_ms="bigint", **_named("double", "open high low close volume"), n_trades="bigint", taker_buy_base="double")
TICKS = layout(ts_ms="bigint", price="double", symbol="string", date="date")
ENRICHED = layout(
    pool="string", symbol="string", block="bigint", log_index="bigint", sender="string", ts_ms="bigint",
    **_named("double", "p_pre p_post dB dQ fee_rate liquidity p_cex p_cex_1s p_cex_h5 p_cex_h30 dev_pre dev_post"), is_arb="boolean", is_arb_strict="boolean",
    **_named("double", "volume_q fee_income lp_gain arb_loss markout_5s markout_30s"),
)
TRANSACTIONS = layout(block="bigint", log_index="bigint", **_named("string", "tx_hash tx_from tx_to"), **_named("bigint", "tx_index gas_used gas_price_wei"), status="int")
CHANGES = layout(change="string", change_block="bigint", change_ms="bigint", dt_pre="double", dt_post="double")
