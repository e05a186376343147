"""Stateless quoting rules: trigger flags and what-if quotes of a state row under a parameter row.

Parameters live in columns (prefix ``p_``): literals of a branch for a few variants, one row per variant for many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock import scratch

# Variants that get a branch each.
FEW = 8
# Parameter names and defaults of run configurations, in alphabetical order; None means "not set".
PARAMETERS: dict[str, tuple[str, object]] = {
    "ask_size_factor_when_sv_neg": ("double", None),
    "base_size": ("double", 1.0),
    "base_spread_bps": ("double", 5.0),
    "boost_only_if_abs_pos_lt": ("double", None),
    "boost_size_factor": ("double", 1.0),
    "boost_spread_add_bps": ("double", 0.0),
    "boost_when_abs_mid_ret_gt": ("double", None),
    "halt_size_factor": ("double", 0.0),
    "halt_when_abs_mid_ret_gt": ("double", None),
    "halt_when_market_spread_bps_gt": ("double", None),
    "halt_when_market_spread_bps_lt": ("double", None),
    "imbalance_size_factor": ("double", 1.0),
    "imbalance_thr": ("double", None),
    "inventory_skew_bps": ("double", 2.0),
    "inventory_target": ("double", 0.0),
    "max_abs_position": ("double", None),
    "micro_bias_ask_only_size_factor": ("double", 1.0),
    "micro_bias_size_factor": ("double", 1.0),
    "micro_bias_thr_bps": ("double", None),
    "micro_bias_thr_pos_bps": ("double", None),
    "micro_pos_size_factor": ("double", 1.0),
    "micro_pos_thr": ("double", None),
    "post_pull_inventory_skew_mult": ("double", 1.0),
    "post_pull_unwind_enable": ("boolean", False),
    "post_pull_unwind_other_side_size_factor": ("double", 1.0),
    "post_pull_unwind_size_factor": ("double", 1.0),
    "post_pull_unwind_spread_add_bps": ("double", 0.0),
    "post_pull_unwind_until_abs_pos_lt": ("double", 0.0),
    "pull_mode": ("string", "symmetric"),
    "pull_signed_volume_window_s": ("double", None),
    "pull_size_factor": ("double", 1.0),
    "pull_spread_add_bps": ("double", 0.0),
    "pull_when_abs_mid_ret_gt": ("double", None),
    "pull_when_abs_signed_volume_gt": ("double", None),
    "pull_when_market_spread_bps_gt": ("double", None),
    "pull_when_market_spread_bps_lt": ("double", None),
    "pull_window_inventory_skew_mult": ("double", 1.0),
    "pull_window_max_abs_position": ("double", None),
    "quote_only_in_boost": ("boolean", False),
    "stop_max_abs_position": ("double", None),
    "stop_max_intraday_drawdown_usdc": ("double", None),
    "stop_mode": ("string", "halt"),
    "stop_when_abs_mid_ret_gt": ("double", None),
    "stop_when_market_spread_bps_gt": ("double", None),
    "stop_when_market_spread_bps_lt": ("double", None),
}


def parameter_columns(**given: object) -> dict[str, Column]:
    """All parameters as literal columns, for one variant."""
    unknown = set(given) - set(PARAMETERS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return {f"p_{n}": F.lit(given.get(n, default)).cast(kind) for n, (kind, default) in PARAMETERS.items()}


def with_variants(states: DataFrame, variants: dict[str, dict[str, object]]) -> DataFrame:
    """Every state row once per variant, with its parameters.

    Up to ``FEW`` variants are branches over the written states: their parameters are literals, so the optimizer folds away the rules that a
    variant leaves unused, and what is left is small enough for the JVM to compile. More variants are rows of a literal array.
    """
    if len(variants) <= FEW:
        held = scratch.keep(states, "states") if len(variants) > 1 else states
        own = [held.withColumns({"variant": F.lit(name), **parameter_columns(**given)}) for name, given in variants.items()]
        return reduce(DataFrame.unionByName, own)
    rows = []
    for name, given in variants.items():
        rows.append(F.struct(F.lit(name).alias("variant"), *[c.alias(n) for n, c in parameter_columns(**given).items()]))
    return states.select("*", F.explode(F.array(*rows)).alias("_variant")).select("*", "_variant.*").drop("_variant")


def _p(name: str) -> Column:
    return F.col(f"p_{name}")


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _non_negative(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def _outside(value: Column, prefix: str) -> Column:
    return _true(value > _p(f"{prefix}_gt")) | _true(value < _p(f"{prefix}_lt"))


def flow() -> Column:
    """Rolling signed volume when a window is set and known, else the block's own; missing counts as zero."""
    rolling = F.when(_p("pull_signed_volume_window_s").isNotNull(), F.col("signed_volume_window"))
    return F.coalesce(rolling, F.col("signed_volume"), F.lit(0.0))


def market_triggers(rows: DataFrame) -> DataFrame:
    """Flags that depend on the market only."""
    width, move = F.col("market_spread_bps"), F.col("abs_mid_ret")
    return rows.withColumns(
        {
            "halt_flag": _outside(width, "halt_when_market_spread_bps") | _true(move > _p("halt_when_abs_mid_ret_gt")),
            "boost_market_flag": _true(move > _p("boost_when_abs_mid_ret_gt")),
            "stop_market_flag": _outside(width, "stop_when_market_spread_bps")
            | _true(move > _p("stop_when_abs_mid_ret_gt")),
            "pull_flag": _outside(width, "pull_when_market_spread_bps")
            | _true(move > _p("pull_when_abs_mid_ret_gt"))
            | _true(F.abs(flow()) > _p("pull_when_abs_signed_volume_gt")),
        }
    )


def ledger_triggers(rows: DataFrame) -> DataFrame:
    """Adds the position and drawdown conditions; needs :func:`market_triggers` columns."""
    held, cap = F.abs(F.col("inv")), _p("boost_only_if_abs_pos_lt")
    capped = _true((cap >= 0) & (held >= cap))
    return rows.withColumns(
        {
            "boost_flag": F.col("boost_market_flag") & ~capped,
            "stop_flag": F.col("stop_market_flag")
            | _true(F.abs(F.col("position")) >= _p("stop_max_abs_position"))
            | _true(F.col("drawdown") <= _p("stop_max_intraday_drawdown_usdc")),
        }
    )


def pull_side() -> Column:
    """Side threatened by the flow: sell when buyers dominate, buy when sellers do, null for balance."""
    return F.when(flow() > 0, F.lit("sell")).when(flow() < 0, F.lit("buy"))


def clamp(size: Column) -> Column:
    cap = _p("max_abs_position")
    return F.when(cap.isNotNull() & (F.abs(size) > cap), F.signum(size) * cap).otherwise(size)


def _side_rule(rows: DataFrame, value: str, threshold: str, factor: str, enabled: Column) -> DataFrame:
    """Shrink the ask at or above +threshold and the bid at or below -threshold."""
    x, thr = F.coalesce(F.col(value), F.lit(0.0)), _p(threshold)
    on = enabled & _true(thr > 0)
    f = _non_negative(_p(factor))
    return rows.withColumns(
        {
            "ask_size": F.when(on & (x >= thr), _non_negative(F.col("ask_size") * f)).otherwise(F.col("ask_size")),
            "bid_size": F.when(on & (x <= -thr), _non_negative(F.col("bid_size") * f)).otherwise(F.col("bid_size")),
        }
    )


def quotes(states: DataFrame) -> DataFrame:
    """What-if quotes per (state, variant).

    Needs ``mid, position, drawdown, market_spread_bps, abs_mid_ret, signed_volume, signed_volume_window,
    imbalance, micro_pos, micro_bias_bps``, a boolean ``unwind_candidate`` (a pull ended and the unwind has not
    been cleared) and the parameter columns. Nothing feeds back from fills to the position.
    """
    number = lambda name: F.col(name)
    rows = states.withColumn("position", F.coalesce(F.col("position"), F.lit(0.0)))
    rows = rows.withColumn("inv", F.col("position") - _p("inventory_target"))
    rows = ledger_triggers(market_triggers(rows))

    priced = F.col("mid").isNotNull()
    stopped = priced & F.col("stop_flag")
    idle = priced & ~stopped & _p("quote_only_in_boost") & ~F.col("boost_flag")
    rows = rows.withColumns({"_stopped": stopped, "_idle": idle})
    rows = rows.withColumn("_live", priced & ~F.col("_stopped") & ~F.col("_idle"))
    rows = rows.withColumns(
        {
            "pull_triggered": F.col("_live") & F.col("pull_flag"),
            "pull_side": F.when(
                F.col("_live") & F.col("pull_flag") & (F.lower(F.trim(_p("pull_mode"))) == "one_side"), pull_side()
            ),
        }
    )

    hits_bid = F.col("pull_triggered") & (F.col("pull_side").isNull() | (F.col("pull_side") == "buy"))
    hits_ask = F.col("pull_triggered") & (F.col("pull_side").isNull() | (F.col("pull_side") == "sell"))
    wider, smaller = _p("base_spread_bps") + _p("pull_spread_add_bps"), _non_negative(_p("base_size") * _p("pull_size_factor"))
    rows = rows.withColumns(
        {
            "bid_spread": F.when(hits_bid, wider).otherwise(_p("base_spread_bps")),
            "ask_spread": F.when(hits_ask, wider).otherwise(_p("base_spread_bps")),
            "bid_size": F.when(hits_bid, smaller).otherwise(_p("base_size")),
            "ask_size": F.when(hits_ask, smaller).otherwise(_p("base_size")),
        }
    )

    # Selling flow: only the ask shrinks.
    limit = _p("pull_when_abs_signed_volume_gt")
    selling = _p("ask_size_factor_when_sv_neg").isNotNull() & _true(limit > 0) & _true(flow() <= -limit)
    rows = rows.withColumns(
        {
            "ask_sv_neg_triggered": selling & F.col("_live"),
            "ask_size": F.when(
                selling, _non_negative(F.col("ask_size") * _non_negative(_p("ask_size_factor_when_sv_neg")))
            ).otherwise(F.col("ask_size")),
        }
    )

    # Microprice bias: the ask-only rule, when set, replaces the two-sided rule.
    bias, positive = F.coalesce(F.col("micro_bias_bps"), F.lit(0.0)), _p("micro_bias_thr_pos_bps")
    rows = rows.withColumn(
        "ask_size",
        F.when(
            _true(positive > 0) & (bias >= positive),
            _non_negative(F.col("ask_size") * _non_negative(_p("micro_bias_ask_only_size_factor"))),
        ).otherwise(F.col("ask_size")),
    )
    rows = _side_rule(rows, "micro_bias_bps", "micro_bias_thr_bps", "micro_bias_size_factor", positive.isNull())
    rows = _side_rule(rows, "imbalance", "imbalance_thr", "imbalance_size_factor", F.lit(True))
    rows = _side_rule(rows, "micro_pos", "micro_pos_thr", "micro_pos_size_factor", F.lit(True))

    # A pull caps what one fill may add to the inventory.
    cap = _p("pull_window_max_abs_position")
    capping = F.col("pull_triggered") & cap.isNotNull()
    room_bid, room_ask = _non_negative(cap - F.col("inv")), _non_negative(cap + F.col("inv"))
    rows = rows.withColumns(
        {
            "bid_size": F.when(capping, F.least(F.col("bid_size"), room_bid)).otherwise(F.col("bid_size")),
            "ask_size": F.when(capping, F.least(F.col("ask_size"), room_ask)).otherwise(F.col("ask_size")),
        }
    )

    # After a pull the side that reduces inventory is eased, the other held back.
    open_until = F.coalesce(_p("post_pull_unwind_until_abs_pos_lt"), F.lit(0.0))
    unwinding = (
        F.col("_live")
        & ~F.col("pull_triggered")
        & _p("post_pull_unwind_enable")
        & _true(F.col("unwind_candidate"))
        & (F.abs(F.col("inv")) > open_until)
    )
    rows = rows.withColumn("post_pull_unwind_active", unwinding)
    long_, short = F.col("post_pull_unwind_active") & (F.col("inv") > 0), F.col("post_pull_unwind_active") & (F.col("inv") < 0)
    add, near, far = (
        _p("post_pull_unwind_spread_add_bps"),
        _non_negative(_p("post_pull_unwind_size_factor")),
        _non_negative(_p("post_pull_unwind_other_side_size_factor")),
    )
    ask, bid = number("ask_size"), number("bid_size")
    rows = rows.withColumns(
        {
            "ask_spread": F.when(long_, _non_negative(F.col("ask_spread") + add)).otherwise(F.col("ask_spread")),
            "bid_spread": F.when(short, _non_negative(F.col("bid_spread") + add)).otherwise(F.col("bid_spread")),
            "ask_size": F.when(long_, _non_negative(ask * near)).when(short, _non_negative(ask * far)).otherwise(ask),
            "bid_size": F.when(long_, _non_negative(bid * far)).when(short, _non_negative(bid * near)).otherwise(bid),
        }
    )

    boost = F.col("boost_flag")
    rows = rows.withColumns(
        {
            f"{side}_spread": F.when(
                boost, _non_negative(F.col(f"{side}_spread") + _p("boost_spread_add_bps"))
            ).otherwise(F.col(f"{side}_spread"))
            for side in ("bid", "ask")
        }
    )
    mult = lambda c: F.when(c < 0, F.lit(1.0)).otherwise(c)
    lean = (
        F.when(F.col("pull_triggered"), mult(_p("pull_window_inventory_skew_mult")))
        .when(F.col("post_pull_unwind_active"), mult(_p("post_pull_inventory_skew_mult")))
        .otherwise(F.lit(1.0))
    )
    rows = rows.withColumn("skew_bps", F.col("inv") * _p("inventory_skew_bps") * lean)
    centre = F.col("mid") * (1 - F.col("skew_bps") / 10_000)
    rows = rows.withColumns(
        {
            "bid_px": centre * (1 - F.col("bid_spread") / 10_000),
            "ask_px": centre * (1 + F.col("ask_spread") / 10_000),
        }
    )

    for condition, factor in ((None, None), (boost, "boost_size_factor"), (F.col("halt_flag"), "halt_size_factor")):
        for side in ("bid_size", "ask_size"):
            if condition is None:
                rows = rows.withColumn(side, clamp(F.col(side)))
            else:
                scaled = clamp(_non_negative(F.col(side) * _non_negative(_p(factor))))
                rows = rows.withColumn(side, F.when(condition, scaled).otherwise(F.col(side)))

    # A stop in unwind mode sends one order at mid on the reducing side.
    held = F.abs(F.col("inv"))
    exit_size = clamp(_non_negative(F.least(_p("base_size"), held)))
    exits = F.col("_stopped") & (F.lower(_p("stop_mode")) == "unwind_only") & (held > 1e-12) & (exit_size > 0)
    silent = F.col("halt_flag") & (F.col("bid_size") <= 0) & (F.col("ask_size") <= 0)
    rows = rows.withColumns({"_exits": exits, "_exit_size": exit_size})
    exit_buy, exit_sell = F.col("_exits") & (F.col("inv") < 0), F.col("_exits") & (F.col("inv") > 0)
    live = F.col("_live")
    rows = rows.withColumns(
        {
            "halt": ~((live & ~silent) | F.col("_exits")),
            "stop_triggered": F.col("_stopped"),
            "halt_triggered": priced & F.col("halt_flag"),
            "boost_triggered": priced & boost,
            "bid_px": F.when(live, F.col("bid_px")).when(exit_buy, F.col("mid")),
            "ask_px": F.when(live, F.col("ask_px")).when(exit_sell, F.col("mid")),
            "bid_size": F.when(live, F.col("bid_size")).when(exit_buy, F.col("_exit_size")),
            "ask_size": F.when(live, F.col("ask_size")).when(exit_sell, F.col("_exit_size")),
            "skew_bps": F.when(live, F.col("skew_bps")),
            "bid_spread_bps": F.when(live, F.col("bid_spread")),
            "ask_spread_bps": F.when(live, F.col("ask_spread")),
        }
    )
    inner = [c for c in rows.columns if c.startswith("p_")]
    return rows.drop(
        "_stopped", "_idle", "_live", "_exits", "_exit_size", "bid_spread", "ask_spread",
        "halt_flag", "boost_market_flag", "stop_market_flag", "pull_flag", "boost_flag", "stop_flag", *inner,
    )


def crosses_post_only(side: Column, price: Column, bid_px: Column, ask_px: Column) -> Column:
    """A post-only order that would match at once; a missing price means the own side's top."""
    own = F.coalesce(price, F.when(side == "buy", bid_px).otherwise(ask_px))
    return F.coalesce(F.when(side == "buy", own >= ask_px).when(side == "sell", own <= bid_px), F.lit(False))
