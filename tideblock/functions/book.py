"""Prices and sizes at the top of the book. Every division returns null when the divisor is null or zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 1e4


def mid(bid_px: Column, ask_px: Column) -> Column:
    return (bid_px + ask_px) / F.lit(2.0)


def spread(bid_px: Column, ask_px: Column) -> Column:
    return ask_px - bid_px


def microprice(bid_px: Column, bid_sz: Column, ask_px: Column, ask_sz: Column) -> Column:
    """Each price weighted by the size on the other side."""
    return F.try_divide(bid_px * ask_sz + ask_px * bid_sz, bid_sz + ask_sz)


def imbalance(bid_sz: Column, ask_sz: Column) -> Column:
    return F.try_divide(bid_sz - ask_sz, bid_sz + ask_sz)


def relative_bps(value: Column, base: Column) -> Column:
    return F.try_divide(value - base, base) * BPS


def micro_pos(micro: Column, mid_px: Column, width: Column) -> Column:
    """Place of the microprice in the spread, relative to mid."""
    return F.try_divide(micro - mid_px, width)


def market_spread_bps(width: Column, mid_px: Column) -> Column:
    return F.try_divide(width * BPS, mid_px)


def book_columns(bid_px: str, bid_sz: str, ask_px: str, ask_sz: str) -> dict[str, Column]:
    """The block-level price columns, as doubles."""
    bp, bs, ap, asz = (F.col(c).cast("double") for c in (bid_px, bid_sz, ask_px, ask_sz))
    m, w, mp = mid(bp, ap), spread(bp, ap), microprice(bp, bs, ap, asz)
    return {
        "mid": m,
        "spread": w,
        "microprice": mp,
        "imbalance": imbalance(bs, asz),
        "micro_bias_bps": relative_bps(mp, m),
        "micro_pos": micro_pos(mp, m, w),
        "market_spread_bps": market_spread_bps(w, m),
    }


def book_top(bids: Column, asks: Column) -> Column:
    """Best bid (highest) and best ask (lowest) of level arrays; the first level wins ties; null for an empty side."""
    bid_keys = F.transform(bids, lambda x, i: F.struct(x["px"].alias("px"), (-i).alias("i"), x["sz"].alias("sz")))
    ask_keys = F.transform(asks, lambda x, i: F.struct(x["px"].alias("px"), i.alias("i"), x["sz"].alias("sz")))
    best_bid, best_ask = F.array_max(bid_keys), F.array_min(ask_keys)
    return F.struct(
        best_bid["px"].alias("bid_px"),
        best_bid["sz"].alias("bid_sz"),
        best_ask["px"].alias("ask_px"),
        best_ask["sz"].alias("ask_sz"),
    )


def missing_book(bids: Column, asks: Column) -> Column:
    return (F.coalesce(F.size(bids), F.lit(0)) <= 0) & (F.coalesce(F.size(asks), F.lit(0)) <= 0)


def book_hash8(bid_px: Column, ask_px: Column, bid_sz: Column, ask_sz: Column) -> Column:
    """First 8 hex digits of SHA-256 over ``bid:ask:bid_sz:ask_sz``; all four are strings."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("None")) for c in (bid_px, ask_px, bid_sz, ask_sz)])
    return F.substring(F.sha2(text, 256), 1, 8)


def book_validity(bid_px: Column, ask_px: Column) -> Column:
    """Why a book cannot be quoted on; null when it can."""
    return (
        F.when(bid_px.isNull() | ask_px.isNull(), F.lit("missing_best_bid_ask"))
        .when(ask_px <= bid_px, F.lit("crossed_or_stale_book"))
    )


def simple_return(now: Column, base: Column) -> Column:
    return F.try_divide(now - base, base)


def signed_size(side: Column, size: Column) -> Column:
    """Positive for buys, negative for sells, null for any other side."""
    return F.when(side == "buy", size).when(side == "sell", -size)
