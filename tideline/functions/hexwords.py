"""Decode 256-bit words of event-log payloads with string expressions (no row-at-a-time Python)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Fixed values of the log encoding: 64 hex digits per word, 40 per address.
WORD_DIGITS = 64
ADDRESS_DIGITS = 40

# conv() works on 64 bits, so a word is read in pieces of at most 13 hex digits (52 bits, exact in a double).
_PIECE = 13


def payload(data: Column) -> Column:
    """Hex payload in lower case without the 0x prefix."""
    return F.regexp_replace(F.lower(data), "^0x", "")


def word(data: Column, index: int) -> Column:
    return F.substring(payload(data), index * WORD_DIGITS + 1, WORD_DIGITS)


def word_count(data: Column) -> Column:
    return F.floor(F.length(payload(data)) / F.lit(WORD_DIGITS)).cast("int")


def words(data: Column) -> Column:
    """All words of a payload as an array, for explode."""
    count = word_count(data)
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.substring(payload(data), i * F.lit(WORD_DIGITS) + F.lit(1), F.lit(WORD_DIGITS)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _magnitude(digits: Column) -> Column:
    total = None
    stop = WORD_DIGITS
    power = 0
    while stop > 0:
        start = max(0, stop - _PIECE)
        piece = F.conv(F.substring(digits, start + 1, stop - start), 16, 10).cast("double") * F.lit(float(16**power))
        total = piece if total is None else piece + total
        power += stop - start
        stop = start
    return total


def unsigned_double(w: Column) -> Column:
    return _magnitude(F.lower(w))


def signed_double(w: Column) -> Column:
    """Two's complement: negative words are read through their bitwise complement, exact near zero."""
    low = F.lower(w)
    flipped = F.translate(low, "0123456789abcdef", "fedcba9876543210")
    negative = F.substring(low, 1, 1).isin("8", "9", "a", "b", "c", "d", "e", "f")
    return F.when(negative, -(_magnitude(flipped) + F.lit(1.0))).otherwise(_magnitude(low))


def decimal_string(w: Column, signed: bool) -> Column:
    """Exact decimal text of a word. Values exceed DECIMAL(38), so an Arrow batch function formats them."""

    @F.pandas_udf(StringType())
    def fmt(batch: pd.Series) -> pd.Series:
        def one(text):
            if text is None or text == "":
                return None
            number = int(text, 16)
            return str(number - (1 << 256) if signed and number >> 255 else number)

        return batch.map(one)

    return fmt(w)


def address_from_topic(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(ADDRESS_DIGITS))))


def topic_from_address(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(payload(address), WORD_DIGITS, "0"))


def hex_to_bigint(text: Column) -> Column:
    """0x-prefixed quantity that fits 63 bits (block number, log index, seconds)."""
    return F.conv(payload(text), 16, 10).cast("bigint")
