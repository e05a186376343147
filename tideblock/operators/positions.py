"""Position ledger: fills and fundings folded into position, cost and pnl with running sums only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.operators import ordered

ORDER = ["ts_ms", "_kind", "_id"]
# Sizes, prices and costs keep the 18 decimals of the ingest type; beyond 18 digits before the point a cast raises.
EXACT = "decimal(36,18)"
COARSE_SIZE, COARSE_PRICE, FINE = "decimal(21,6)", "decimal(16,6)", "decimal(18,18)"


def _times(size: Column, price: Column) -> Column:
    """size * price to 18 decimals. No decimal holds the product of 18 and 18 decimals, so both are split at the sixth.

    Sizes of 1e15 and prices of 1e10 or more raise.
    """
    coarse_size, coarse_price = size.cast(COARSE_SIZE), price.cast(COARSE_PRICE)
    fine_size, fine_price = (size - coarse_size).cast(FINE), (price - coarse_price).cast(FINE)
    parts = (coarse_size * coarse_price, coarse_size * fine_price, fine_size * coarse_price, fine_size * fine_price)
    first, *rest = (p.cast("decimal(33,18)") for p in parts)
    for p in rest:
        first = first + p
    return first.cast(EXACT)


def _events(fills: DataFrame, fundings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fundings and fills in one series; at one instant fundings come first."""
    deals = fills.select(
        *keys, "ts_ms", F.lit(1).alias("_kind"), F.col("trade_id").cast("string").alias("_id"), "trade_id", "side", "px", "sz",
        F.coalesce(F.col("fee"), F.lit(0.0)).cast("double").alias("fee"),
    )
    paid = fundings.select(
        *keys, "ts_ms", F.lit(0).alias("_kind"), F.col("funding_id").cast("string").alias("_id"),
        F.col("amount").cast("double").alias("amount"),
    )
    return deals.unionByName(paid, allowMissingColumns=True)


def _finish(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unrealised and total pnl; keeps fills and the fundings after the last fill of each key."""
    last_fill = rows.filter(F.col("_kind") == 1).groupBy(*keys).agg(F.max("ts_ms").alias("_last"))
    out = rows.join(last_fill, list(keys), "left").filter(
        (F.col("_kind") == 1) | F.col("_last").isNull() | (F.col("ts_ms") > F.col("_last"))
    )
    pos = F.col("position").cast("double")
    unrealized = F.coalesce((F.col("last_px").cast("double") - F.col("avg_cost")) * pos, F.lit(0.0))
    return out.select(
        *keys, "ts_ms", "trade_id", "side", F.col("px").cast("double").alias("px"), F.col("sz").cast("double").alias("sz"),
        pos.alias("position"), "avg_cost", "price_pnl", "fees", F.lit(0.0).alias("rebates"), "funding",
        unrealized.alias("unrealized_pnl"),
        (F.col("price_pnl") + F.col("fees") + F.col("funding") + unrealized).alias("total_pnl"),
    )


def position_ledger(fills: DataFrame, fundings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fill, and per funding after the last fill.

    A close that leaves a remainder restarts the average cost at the fill price. Each fill that does not add to
    an open position therefore starts a segment, and cost is a running sum within the segment: the running sum
    over everything less its value where the segment began. Sizes and prices are decimals, so a closed position
    is exactly zero.
    """
    px, size = F.col("px").cast(EXACT), F.col("sz").cast(EXACT)
    signed = F.when(F.col("side") == "buy", size).when(F.col("side").isNotNull(), -size).otherwise(F.lit(0).cast(EXACT))
    events = _events(fills, fundings, keys).withColumns({"px": px, "_s": signed, "_fill": F.col("_kind") == 1})
    held = ordered.scan(
        ordered.chunk(events, keys, ORDER), keys, ORDER,
        position=ordered.running_sum(F.col("_s")),
        _fees=ordered.running_sum(-F.col("fee")),
        funding=ordered.running_sum(F.col("amount")),
        last_px=ordered.last_seen(F.col("px")),
    )
    before = F.col("position").cast(EXACT) - F.col("_s")
    adds = (before != 0) & (F.signum(before) == F.signum(F.col("_s")))
    cost = F.when(F.col("_fill") & ~adds, _times(F.col("position").cast(EXACT), F.col("px"))).otherwise(
        F.coalesce(_times(F.col("_s").cast(EXACT), F.col("px")), F.lit(0))
    )
    marked = scratch.keep(
        held.withColumns({"_before": before, "_starts": F.col("_fill") & ~adds, "_cost": cost.cast(EXACT)}),
        "ledger",
    )
    summed = scratch.keep(
        ordered.scan(marked, keys, ORDER, _upto=ordered.running_sum(F.col("_cost"))), "ledger"
    )
    base = F.when(F.col("_starts"), F.col("_upto") - F.col("_cost"))
    based = ordered.scan(
        summed, keys, ORDER, _base=ordered.last_seen(base), _base_before=ordered.last_before(base)
    )
    old_cost = (F.col("_upto") - F.col("_cost") - F.col("_base_before")).cast("double")
    old_avg = F.try_divide(old_cost, F.col("_before").cast("double"))
    closed = F.least(F.abs("_before"), F.abs("_s")).cast("double")
    gain = F.when(
        F.col("_starts") & (F.col("_before") != 0),
        closed * (F.col("px").cast("double") - old_avg) * F.signum(F.col("_before").cast("double")),
    ).otherwise(F.lit(0.0))
    avg_cost = F.when(
        F.col("position") != 0, (F.col("_upto") - F.col("_base")).cast("double") / F.col("position").cast("double")
    )
    priced = scratch.keep(based.withColumns({"avg_cost": avg_cost, "_gain": gain}), "ledger")
    out = ordered.scan(priced, keys, ORDER, price_pnl=ordered.running_sum(F.col("_gain")))
    return _finish(
        out.withColumns({"fees": F.coalesce("_fees", F.lit(0.0)), "funding": F.coalesce("funding", F.lit(0.0))}), keys
    )


def average_cost_ledger(fills: DataFrame, fundings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same ledger with true average cost: a partial close keeps the average of the remainder.

    Given the position (a running sum), each event maps the open cost ``C`` and the realised pnl ``G`` to ``a * C + b`` and
    ``G + g * C + h``. Such maps compose to maps of the same form, so the ledger is their running composition.
    """
    size = F.col("sz").cast(EXACT)
    signed = F.when(F.col("side") == "buy", size).when(F.col("side").isNotNull(), -size).otherwise(F.lit(0).cast(EXACT))
    events = _events(fills, fundings, keys).withColumns({"px": F.col("px").cast("double"), "_s": signed})
    held = ordered.scan(
        ordered.chunk(events, keys, ORDER), keys, ORDER,
        position=ordered.running_sum(F.col("_s")),
        _fees=ordered.running_sum(-F.col("fee")),
        funding=ordered.running_sum(F.col("amount")),
        last_px=ordered.last_seen(F.col("px")),
    )
    rows = held.withColumns(
        {
            "_signed": F.col("_s").cast("double"),
            "_before": (F.col("position").cast(EXACT) - F.col("_s")).cast("double"),
            "_after": F.col("position").cast("double"),
        }
    )
    folded = ordered.fold(rows, keys, ORDER, "_map", _cost_map(), _then)
    return _finish(
        folded.withColumns(
            {
                "avg_cost": F.when(F.col("_after") != 0, F.col("_map.b") / F.col("_after")),
                "price_pnl": F.col("_map.h"),
                "fees": F.coalesce("_fees", F.lit(0.0)),
                "funding": F.coalesce("funding", F.lit(0.0)),
            }
        ),
        keys,
    )


def _cost_map() -> Column:
    """What an event does to the open cost (``a``, ``b``) and to the realised pnl (``g``, ``h``)."""
    before, signed, after, px = F.col("_before"), F.col("_signed"), F.col("_after"), F.col("px")
    fill = F.col("_kind") == 1
    adds, keeps, closes = before * signed > 0, before * after > 0, fill & (before * signed < 0)
    closed = F.least(F.abs(before), F.abs(signed)) * F.signum(before)
    zero, one = F.lit(0.0), F.lit(1.0)
    value = lambda c: F.coalesce(c, zero)
    return F.struct(
        F.when(~fill | adds, one).when(keeps, after / before).otherwise(zero).alias("a"),
        F.when(~fill, zero).when(adds, value(signed * px)).when(keeps, zero).otherwise(value(after * px)).alias("b"),
        F.when(closes, -closed / before).otherwise(zero).alias("g"),
        F.when(closes, value(closed * px)).otherwise(zero).alias("h"),
    )


def _then(x: Column, y: Column) -> Column:
    """The map that does ``x``, then ``y``."""
    return F.struct(
        (y["a"] * x["a"]).alias("a"), (y["a"] * x["b"] + y["b"]).alias("b"), (x["g"] + y["g"] * x["a"]).alias("g"), (x["h"] + y["g"] * x["b"] + y["h"]).alias("h")
    )
