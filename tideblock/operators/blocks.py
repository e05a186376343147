"""Alignment of trades, contexts and BBOs to order-book snapshots, and the per-block columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import book as bk
from tideblock.operators import ordered
from tideblock.operators.asof import asof

KEYS = ["symbol"]
ORDER = ["ts_ms", "event_id"]
BLOCK = ["block_ts_ms", "book_event_id"]
TOP = ["bid_px", "bid_sz", "ask_px", "ask_sz"]
TRADE_CHUNK = 10_000
EXACT = "decimal(38,18)"


def bucket_trades(trades: DataFrame, books: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each trade with the first block at or after it; trades after the last block are dropped."""
    hit = asof(
        trades, books, keys, at="ts_ms", quote_at="ts_ms", payload=["event_id"], ties=["event_id"],
        direction="forward", into="_block",
    )
    return hit.filter(F.col("_block").isNotNull()).select(
        *trades.columns,
        F.col("_block.at_ms").alias("block_ts_ms"),
        F.col("_block.event_id").alias("book_event_id"),
    )


def block_flow(bucketed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per block: trade count, strict and lenient signed volume, last trade price."""
    size = F.col("sz").cast("double")
    signed = bk.signed_size(F.col("side"), size)
    usable = F.when(size > 0, signed)
    return bucketed.groupBy(*keys, *BLOCK).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(signed.isNull()).alias("_bad"),
        F.sum(signed).alias("_strict"),
        F.coalesce(F.sum(usable), F.lit(0.0)).alias("signed_volume_lenient"),
        F.max_by(F.col("px").cast("double"), F.when(F.col("px").isNotNull(), F.struct(*ORDER))).alias("_last_px"),
    ).select(
        *keys, *BLOCK, "n_trades",
        F.when(F.col("_bad") == 0, F.col("_strict")).alias("signed_volume"),
        "signed_volume_lenient",
        F.when(F.col("_bad") == 0, F.col("_last_px")).alias("last_trade_px"),
    )


def blocks(books: DataFrame, trades: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per snapshot with its flow; the trades themselves stay in :func:`bucket_trades`."""
    named = books.withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    flow = block_flow(bucket_trades(trades, books, keys), keys)
    return (
        named.join(flow, [*keys, *BLOCK], "left")
        .withColumn("n_trades", F.coalesce("n_trades", F.lit(0).cast("bigint")))
        .withColumn("signed_volume_lenient", F.coalesce("signed_volume_lenient", F.lit(0.0)))
        .withColumn("missing_trades", F.col("n_trades") == 0)
    )


def carry_forward(
    block_rows: DataFrame, updates: DataFrame, payload: Sequence[str], into: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Last update (context, BBO) at or before each block, as the struct ``into``."""
    return asof(
        block_rows, updates, keys, at="block_ts_ms", quote_at="ts_ms", payload=payload, ties=["event_id"], into=into
    )


def nested_trades(bucketed: DataFrame, keys: Sequence[str] = KEYS, size: int = TRADE_CHUNK) -> DataFrame:
    """Trade arrays per block, in order, in rows of at most ``size`` trades (``part`` counts from 0)."""
    place = [*keys, *BLOCK]
    numbered = ordered.over(bucketed, place, ORDER, _n=ordered.row_count())
    trade = F.struct(*ORDER, "px", "sz", "side", "trade_id")
    return (
        numbered.withColumn("part", F.floor((F.col("_n") - 1) / F.lit(size)))
        .groupBy(*place, "part")
        .agg(F.sort_array(F.collect_list(trade)).alias("trade_bucket"))
    )


def clip_bucket(nested: DataFrame, start_ms: Column) -> DataFrame:
    """Drop trades before the window start from each trade array."""
    return nested.withColumn("trade_bucket", F.filter("trade_bucket", lambda t: t["ts_ms"] >= start_ms))


def features(block_rows: DataFrame) -> DataFrame:
    """Eight block features with a missing flag each."""
    out = block_rows.withColumns(bk.book_columns(*TOP)).withColumn(
        "basis_bps", bk.relative_bps(F.col("last_trade_px"), F.col("mid"))
    )
    names = ["mid", "spread", "microprice", "micro_bias_bps", "micro_pos", "imbalance", "signed_volume", "basis_bps"]
    return out.withColumns({f"missing_{n}": F.col(n).isNull() for n in names})


def market_state(block_rows: DataFrame, keys: Sequence[str] = KEYS, reconnect_gap_ms: int | None = None) -> DataFrame:
    """Price columns, returns against the previous block, and change flags.

    With ``reconnect_gap_ms`` the previous mid is forgotten when the gap to the previous block reaches it.
    """
    rows = block_rows.withColumns(bk.book_columns(*TOP)).withColumn(
        "book_hash8", bk.book_hash8(F.col("bid_px"), F.col("ask_px"), F.col("bid_sz"), F.col("ask_sz"))
    )
    before = F.struct("block_ts_ms", "mid", "bid_px", "ask_px", "book_hash8")
    seen = ordered.over(rows, keys, BLOCK, _prev=ordered.previous(before))
    gap = F.col("block_ts_ms") - F.col("_prev.block_ts_ms")
    prev_mid = F.col("_prev.mid")
    if reconnect_gap_ms is not None:
        reconnect = F.coalesce(gap >= reconnect_gap_ms, F.lit(False))
        seen = seen.withColumn("reconnect", reconnect)
        prev_mid = F.when(~F.col("reconnect"), prev_mid)
    known = F.col("_prev").isNotNull()
    out = seen.withColumns(
        {
            "mid_ret": bk.simple_return(F.col("mid"), prev_mid),
            "top_px_change": known
            & ~(F.col("bid_px").eqNullSafe(F.col("_prev.bid_px")) & F.col("ask_px").eqNullSafe(F.col("_prev.ask_px"))),
            "mid_change": known & ~F.col("mid").eqNullSafe(F.col("_prev.mid")),
            "book_change": known & (F.col("book_hash8") != F.col("_prev.book_hash8")),
        }
    )
    return out.withColumn("abs_mid_ret", F.abs("mid_ret")).drop("_prev")


def rolling_sum(
    rows: DataFrame, value: str, window_ms: int, keys: Sequence[str] = KEYS, order: Sequence[str] = BLOCK,
    into: str = "signed_volume_window",
) -> DataFrame:
    """Sum of ``value`` over rows up to this one whose time is at least ``t - window_ms``.

    The running sum up to this row, less the running sum of everything before the window. Both are decimals, so what
    lies before the window leaves nothing behind. Later rows of the same instant are not included.
    """
    time = order[0]
    chunks = ordered.chunk(rows, keys, order)
    running = ordered.scan(chunks, keys, order, _upto=ordered.running_sum(F.col(value).cast(EXACT))).drop(ordered.CHUNK)
    summed = scratch.keep(running, "running")
    out = asof(
        summed, summed, keys, at=F.col(time) - window_ms, quote_at=time, payload=["_upto"], ties=order[1:],
        strict=True, into="_gone",
    )
    none = F.lit(0).cast(EXACT)
    held = F.coalesce(F.col("_upto"), none) - F.coalesce(F.col("_gone._upto"), none)
    return out.withColumn(into, held.cast("double")).drop("_upto", "_gone")


def book_change_summary(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Samples, distinct tops, distinct book hashes and number of changes per key."""
    state = scratch.keep(market_state(rows, keys), "state")
    basic = state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("top_px_change")).alias("top_changes"),
        F.count_if(F.col("book_change")).alias("book_changes"),
    )
    tops = state.groupBy(*keys, "bid_px", "ask_px").agg(F.lit(1).alias("_one"))
    hashes = state.groupBy(*keys, "book_hash8").agg(F.lit(1).alias("_one"))
    unique = tops.groupBy(*keys).agg(F.count("_one").alias("unique_tops"))
    unique_hash = hashes.groupBy(*keys).agg(F.count("_one").alias("unique_hashes"))
    return basic.join(unique, list(keys)).join(unique_hash, list(keys))
