"""Evaluation of orders against the trades of their block, without feedback to the position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideblock.functions.quoting import crosses_post_only
from tideblock.operators import ordered

# Prices are compared as they come in, with all decimals.
PRICE = "decimal(38,18)"
AXIS = ["_u", "_kind", "_tie"]
BLOCK_KEY = ["symbol", "book_event_id"]
TRADE_ORDER = ["ts_ms", "event_id"]


def with_limit(orders: DataFrame) -> DataFrame:
    """``limit_px``: the order's price, or the opposite top for an order without one."""
    opposite = F.when(F.col("side") == "buy", F.col("ask_px")).otherwise(F.col("bid_px"))
    return orders.withColumn("limit_px", F.coalesce(F.col("price"), opposite))


def _hit_side(order_side: Column) -> Column:
    return F.when(order_side == "buy", F.lit("sell")).when(order_side == "sell", F.lit("buy"))


def _by_price(orders: DataFrame, bucketed: DataFrame, keys: Sequence[str], totals: Callable[[DataFrame, list[str]], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Price levels with their ``totals`` and orders in one series per (block, side), from the best price for the order.

    An order comes after the levels that it reaches, its own limit included, so a running value over the levels is the order's answer.
    """
    reach = lambda side, px: F.when(side == "sell", px.cast(PRICE)).otherwise(-px.cast(PRICE))
    usable = bucketed.filter(F.col("px").isNotNull() & (F.col("sz") > 0) & F.col("side").isin("buy", "sell"))
    place = [*keys, "_hit"]
    priced = usable.withColumns({"_hit": F.col("side"), "_u": reach(F.col("side"), F.col("px"))})
    levels = totals(priced, [*place, "_u"]).withColumn("_kind", F.lit(0))
    hit = F.coalesce(_hit_side(F.col("side")), F.lit(""))
    asked = orders.withColumns({"_hit": hit, "_u": reach(hit, F.col("limit_px")), "_kind": F.lit(1)})
    series = asked.unionByName(levels, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())
    return ordered.chunk(series, place, AXIS), place


def eligible_volume(orders: DataFrame, bucketed: DataFrame, keys: Sequence[str] = BLOCK_KEY) -> DataFrame:
    """Volume, value and count of the block's opposite trades at or through each order's limit.

    Trades are summed per (block, side, price) and accumulated along the price axis. No order-trade pairs are formed.
    """
    sums = [F.sum("sz").alias("_sz"), F.sum(F.col("px") * F.col("sz")).alias("_val"), F.count(F.lit(1)).alias("_n")]
    series, place = _by_price(orders, bucketed, keys, lambda trades, by: trades.groupBy(*by).agg(*sums))
    summed = ordered.scan(
        series, place, AXIS,
        _volume=ordered.running_sum(F.col("_sz")),
        _value=ordered.running_sum(F.col("_val")),
        _count=ordered.running_sum(F.col("_n")),
    )
    return summed.filter(F.col("_kind") == 1).drop(*place[-1:], *AXIS, "_sz", "_val", "_n", ordered.CHUNK)


def first_prints(orders: DataFrame, bucketed: DataFrame, prints: int, keys: Sequence[str] = BLOCK_KEY) -> DataFrame:
    """The same totals over the first ``prints`` eligible trades in time order.

    Each price level keeps its first ``prints`` trades. Along the price axis the lists of two stretches merge into the first ``prints``
    trades of both, so an order finds the first trades of all levels it reaches, and no order-trade pairs are formed.
    """
    trade = F.struct(*TRADE_ORDER, F.col("px").cast("double").alias("px"), F.col("sz").cast("double").alias("sz"))

    def first(trades: DataFrame, by: list[str]) -> DataFrame:
        place = Window.partitionBy(*by).orderBy(*TRADE_ORDER)
        few = trades.withColumn("_i", F.row_number().over(place)).filter(F.col("_i") <= prints)
        return few.groupBy(*by).agg(F.sort_array(F.collect_list(trade)).alias("_prints"))

    series, place = _by_price(orders, bucketed, keys, first)
    kind = series.schema["_prints"].dataType.simpleString()
    none = F.array().cast(kind)
    merge = lambda a, b: F.slice(F.sort_array(F.concat(a, b)), 1, prints)
    merged = ordered.fold(series, place, AXIS, "_first", F.coalesce("_prints", none), merge)
    some = F.size("_first") > 0
    total = lambda of: F.when(some, F.aggregate("_first", F.lit(0.0), lambda s, t: s + of(t)))
    answers = merged.filter(F.col("_kind") == 1).withColumns(
        {
            "_volume": total(lambda t: t["sz"]),
            "_value": total(lambda t: t["px"] * t["sz"]),
            "_count": F.when(some, F.size("_first").cast("bigint")),
        }
    )
    return answers.drop(*place[-1:], *AXIS, "_prints", "_first", ordered.CHUNK)


def evaluate(
    orders: DataFrame, bucketed: DataFrame, keys: Sequence[str] = BLOCK_KEY, *, model: str = "upper",
    alpha: float | Sequence[float] = 0.5, prints: int | None = None, at_limit: bool = False,
) -> DataFrame:
    """``fill_size``, ``fill_price`` and ``trades_used`` of each order under a fill model.

    Orders have ``order_id``, ``side``, ``size`` and ``limit_px``. ``upper`` takes all eligible volume, ``lower``
    the share ``alpha`` of it, or of its first ``prints`` trades; several alphas give one row each. ``at_limit``
    fills orders without eligible trades in full at their limit.
    """
    if model == "lower" and prints is not None:
        totals = first_prints(orders, bucketed, prints, keys)
    else:
        totals = eligible_volume(orders, bucketed, keys)
    alphas = [1.0] if model == "upper" else ([alpha] if isinstance(alpha, float) else list(alpha))
    tried = totals.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    some = F.col("_volume").isNotNull()
    rest_size, rest_price = (F.col("size"), F.col("limit_px")) if at_limit else (F.lit(None), F.lit(None))
    return tried.withColumns(
        {
            "fill_size": F.when(some, F.least(F.col("size"), F.col("_volume") * F.col("alpha"))).otherwise(rest_size),
            "fill_price": F.when(some, F.col("_value") / F.col("_volume")).otherwise(rest_price),
            "trades_used": F.coalesce("_count", F.lit(0).cast("bigint")),
        }
    ).drop("_volume", "_value", "_count")


def order_status(filled: DataFrame) -> DataFrame:
    """Status of each evaluated order; needs ``post_only``, the block's top and the fill columns."""
    bad = ~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)) | F.coalesce(F.col("size") == 0, F.lit(True))
    crossing = F.col("post_only") & crosses_post_only(F.col("side"), F.col("price"), F.col("bid_px"), F.col("ask_px"))
    status = (
        F.when(bad, F.lit("invalid"))
        .when(crossing, F.lit("invalid_cross"))
        .when(F.col("limit_px").isNull(), F.lit("invalid_no_liquidity"))
        .when(F.coalesce(F.col("fill_size") <= 0, F.lit(True)), F.lit("no_fill"))
        .otherwise(F.lit("filled"))
    )
    return filled.withColumn("status", status)


def fees(size: Column, price: Column, post_only: Column, maker_bps: float, taker_bps: float) -> dict[str, Column]:
    """Maker fills earn a rebate, taker fills pay a fee."""
    value = F.abs(size) * price
    return {
        "rebate": F.when(post_only, value * (maker_bps / 1e4)).otherwise(F.lit(0.0)),
        "fee": F.when(post_only, F.lit(0.0)).otherwise(value * (taker_bps / 1e4)),
    }


def unwind_latch(rows: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float) -> DataFrame:
    """``post_pull_unwind_active``: on from the row after a pull until the inventory falls to the threshold.

    Needs ``pull`` and ``clears`` (stop, idle or mid-less rows) booleans and ``inv``. A pull or a clearing row
    starts an island; a row is active when its island began with a pull, it is not that pull itself, and the
    inventory has stayed above the threshold on every row since.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    starts = on("pull") | on("clears")
    chunks = ordered.chunk(rows.withColumn("_starts", starts), keys, order)
    islands = ordered.scan(
        chunks, keys, order,
        _island=ordered.running_sum(F.col("_starts").cast("bigint")),
        _from_pull=ordered.last_seen(F.when(F.col("_starts"), on("pull"))),
    )
    held = F.when(~F.col("_starts"), F.coalesce(F.abs(F.col("inv")), F.lit(0.0)))
    least = ordered.scan(islands, [*keys, "_island"], order, _least=ordered.running_min(held))
    active = ~F.col("_starts") & F.coalesce(F.col("_from_pull"), F.lit(False)) & (F.col("_least") > threshold)
    return least.withColumn("post_pull_unwind_active", F.coalesce(active, F.lit(False))).drop(
        "_starts", "_island", "_from_pull", "_least", ordered.CHUNK
    )
