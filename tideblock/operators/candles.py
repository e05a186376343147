"""OHLCV bars from trades, coarser bars from bars, and synthetic books from bars."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Milliseconds per interval unit.
UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}


def interval_ms(text: str) -> int:
    """Milliseconds of ``15m``, ``1h``, ``2d``."""
    match = re.fullmatch(r"\s*(\d+)\s*([mhd])\s*", text.lower())
    if not match or int(match.group(1)) <= 0:
        raise ValueError(f"bad interval: {text!r}")
    return int(match.group(1)) * UNIT_MS[match.group(2)]


def interval_ms_of(text: Column) -> Column:
    """The same for a column of interval texts; null for anything else."""
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+\s*([mhdMHD])\s*$", 1))
    count = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("bigint")
    length = F.when(F.lit(False), F.lit(0))
    for name, size in UNIT_MS.items():
        length = length.when(unit == name, F.lit(size))
    return count * length


def ohlcv(trades: DataFrame, length_ms: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Bars over [t, t + length); first and last by (time, id); empty bars are absent."""
    position = F.struct("ts_ms", "event_id")
    t = (F.floor(F.col("ts_ms") / F.lit(length_ms)) * length_ms).cast("bigint")
    return trades.groupBy(*keys, t.alias("t")).agg(
        F.min_by("px", position).alias("o"),
        F.max("px").alias("h"),
        F.min("px").alias("l"),
        F.max_by("px", position).alias("c"),
        F.sum("sz").alias("v"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("t_end", F.col("t") + length_ms - 1)


def roll_up(bars: DataFrame, length_ms: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Coarser bars from bars."""
    start = (F.floor(F.col("t") / F.lit(length_ms)) * length_ms).cast("bigint")
    return bars.groupBy(*keys, start.alias("t0")).agg(
        F.min_by("o", "t").alias("o"),
        F.max("h").alias("h"),
        F.min("l").alias("l"),
        F.max_by("c", "t").alias("c"),
        F.sum("v").alias("v"),
        F.sum("n").alias("n"),
    ).withColumnRenamed("t0", "t").withColumn("t_end", F.col("t") + length_ms - 1)


def to_blocks(bars: DataFrame, book_spread_bps: float, interval: str) -> DataFrame:
    """A one-level book around each close, stamped at the bar's last millisecond."""
    close, half = F.col("c").cast("double"), book_spread_bps / 1e4 / 2.0
    return bars.select(
        "symbol",
        F.col("t_end").alias("block_ts_ms"),
        F.concat_ws(":", F.lit("candle"), "symbol", F.lit(interval), F.col("t").cast("string")).alias("book_event_id"),
        (close * (1.0 - half)).alias("bid_px"),
        F.lit(1.0).alias("bid_sz"),
        (close * (1.0 + half)).alias("ask_px"),
        F.lit(1.0).alias("ask_sz"),
        F.lit(False).alias("missing_book"),
        F.lit(True).alias("missing_trades"),
    )


def first_bars(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The first ``n`` bars in time order."""
    return bars.orderBy("t", *keys).limit(n)
