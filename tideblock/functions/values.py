"""Parsing, normalising and classifying single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"

# Accepted spellings of a side.
BUY_WORDS = ["b", "buy", "bid"]
SELL_WORDS = ["a", "s", "sell", "ask"]

# Symbol suffixes dropped, longest first.
SYMBOL_SUFFIXES = ["USDCPERP", "PERP"]

# Exchange error texts, lower case.
POST_ONLY_TEXTS = [
    "post-only",
    "post only",
    "postonly",
    "would immediately match",
    "would take",
    "would cross",
]
RATE_LIMIT_TEXTS = ["too many cumulative requests"]
CANNOT_MODIFY_TEXTS = ["cannot modify canceled or filled order"]
MARGIN_TEXTS = ["insufficient margin"]

# Keys under which a client order id may be nested.
CLIENT_ID_KEYS = ["cloid", "client_oid", "clientOid", "value", "hex", "id"]

# Words read as true.
TRUE_WORDS = ["1", "true", "yes", "y", "on"]

SECONDS_LIMIT = 1_000_000_000_000
ONE_TICK_TOLERANCE = 0.25


def canonical_symbol(value: Column) -> Column:
    bare = F.upper(F.regexp_replace(value, "[^A-Za-z0-9@]", ""))
    out = F.when(F.lit(False), bare)
    for suffix in SYMBOL_SUFFIXES:
        left = F.length(bare) - len(suffix)
        stem = F.when(left > 0, F.substring(bare, F.lit(1), left)).otherwise(bare)
        out = out.when(bare.endswith(suffix), stem)
    return out.otherwise(bare)


def normalize_side(value: Column) -> Column:
    word = F.lower(F.trim(value))
    return F.when(word.isin(BUY_WORDS), F.lit("buy")).when(word.isin(SELL_WORDS), F.lit("sell"))


def to_decimal(value: Column) -> Column:
    return value.try_cast(DECIMAL)


def to_double(value: Column) -> Column:
    """Double, or null for anything unreadable or not a number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(value: Column) -> Column:
    number = value.cast("double")
    return number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))


def event_time(ts_ms: Column, recv_ts_ms: Column) -> Column:
    return F.coalesce(ts_ms, recv_ts_ms)


def event_id(given: Column, channel: Column, symbol: Column, ts_ms: Column, recv_ts_ms: Column) -> Column:
    made = F.concat_ws(":", channel, F.coalesce(symbol, F.lit("")), event_time(ts_ms, recv_ts_ms).cast("string"))
    return F.coalesce(F.nullif(given, F.lit("")), made)


def _mentions(text: Column, parts: list[str]) -> Column:
    low = F.lower(text)
    found = low.contains(parts[0])
    for part in parts[1:]:
        found = found | low.contains(part)
    return F.coalesce(found, F.lit(False))


def is_post_only_reject(text: Column) -> Column:
    return _mentions(text, POST_ONLY_TEXTS)


def is_rate_limit(text: Column) -> Column:
    return _mentions(text, RATE_LIMIT_TEXTS)


def is_cannot_modify(text: Column) -> Column:
    return _mentions(text, CANNOT_MODIFY_TEXTS)


def is_margin_error(text: Column) -> Column:
    return _mentions(text, MARGIN_TEXTS)


def order_error_class(text: Column) -> Column:
    return (
        F.when(is_post_only_reject(text), F.lit("post_only_reject"))
        .when(is_rate_limit(text), F.lit("rate_limit"))
        .when(is_cannot_modify(text), F.lit("cannot_modify"))
        .when(is_margin_error(text), F.lit("insufficient_margin"))
    )


def one_tick_spread(ticks: Column) -> Column:
    return F.coalesce(F.abs(ticks - 1.0) <= ONE_TICK_TOLERANCE, F.lit(False))


def client_id(text: Column) -> Column:
    """Trimmed id; for a JSON object the first non-empty of the known keys."""
    trimmed = F.nullif(F.trim(text), F.lit(""))
    nested = F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, f"$.{k}")), F.lit("")) for k in CLIENT_ID_KEYS])
    return F.when(trimmed.startswith("{"), nested).otherwise(trimmed)


def epoch_ms(*candidates: Column) -> Column:
    """First usable time of the candidates; values below 10^12 are seconds. Zero counts as absent."""
    raw = F.coalesce(*[F.nullif(c.cast("double"), F.lit(0.0)) for c in candidates])
    return F.when(raw < SECONDS_LIMIT, (raw * 1000).cast("bigint")).otherwise(raw.cast("bigint"))


def truthy(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number.isNotNull(), number != 0).otherwise(F.lower(F.trim(text)).isin(TRUE_WORDS))


def decimal_text(value: Column, strip_zeros: bool = False) -> Column:
    """Plain decimal notation, optionally without trailing zeros."""
    text = value.cast("string")
    # Zeros after the last other decimal, or the whole fraction when it is all zeros.
    return F.regexp_replace(text, r"(\.[0-9]*[1-9])0+$|\.0*$", "$1") if strip_zeros else text


def price_tick(value: Column) -> Column:
    """Tick implied by the printed decimals of a price; null for null or zero."""
    text = value.cast("string")
    digits = F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)
    return F.when(value != 0, F.pow(F.lit(10.0), -digits))


def time_tag(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms.cast("bigint")), "yyyyMMdd_HHmm")


def micros_to_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))
