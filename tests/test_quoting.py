"""What-if quotes: thresholds, sizes and prices worked out from the rules, and properties that hold for any parameters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tideblock.functions import quoting as qt

NUMBERS = ["mid", "position", "drawdown", "market_spread_bps", "abs_mid_ret", "signed_volume", "signed_volume_window", "imbalance", "micro_pos", "micro_bias_bps"]
STATE = "case string, " + ", ".join(f"{n} double" for n in NUMBERS) + ", unwind_candidate boolean"
MID = 250.0
BASE = dict(base_spread_bps=4.0, base_size=3.0, inventory_skew_bps=0.0)


def quotes(spark, cases: dict[str, tuple[dict, dict]]) -> dict[str, dict]:
    """Quotes of each named (state, parameters)."""
    rows = []
    for name, (state, _) in cases.items():
        row = {"case": name, **dict.fromkeys(NUMBERS), "mid": MID, "position": 0.0, "unwind_candidate": False, **state}
        rows.append(tuple(row[c] for c in ["case", *NUMBERS, "unwind_candidate"]))
    out = qt.quotes(qt.with_variants(spark.createDataFrame(rows, STATE), {name: p for name, (_, p) in cases.items()}))
    return {r["case"]: r.asDict() for r in out.filter(F.col("case") == F.col("variant")).collect()}


def sizes(q: dict) -> tuple:
    return q["bid_size"], q["ask_size"]


def away(q: dict) -> tuple:
    """Distance of both prices from the mid in bps."""
    return (MID - q["bid_px"]) / MID * 1e4, (q["ask_px"] - MID) / MID * 1e4


def test_prices_and_sizes_without_triggers(spark):
    got = quotes(spark, {"quiet": ({}, BASE), "blind": ({"mid": None}, BASE), "capped": ({}, dict(BASE, max_abs_position=0.75))})
    assert (got["quiet"]["bid_px"], got["quiet"]["ask_px"]) == (pytest.approx(249.9), pytest.approx(250.1)) and sizes(got["quiet"]) == (3.0, 3.0)
    assert got["blind"]["halt"] and got["blind"]["bid_px"] is None and sizes(got["blind"]) == (None, None)
    assert sizes(got["capped"]) == (0.75, 0.75)


def test_more_inventory_lowers_both_prices(spark):
    held = [-7.0, -2.5, 0.0, 1.25, 6.0]
    got = quotes(spark, {str(p): ({"position": p}, dict(BASE, inventory_skew_bps=1.5)) for p in held})
    for side in ("bid_px", "ask_px"):
        prices = [got[str(p)][side] for p in held]
        assert prices == sorted(prices, reverse=True) and len(set(prices)) == len(held)
    step = (got["0.0"]["bid_px"] - got["6.0"]["bid_px"]) / MID * 1e4
    assert step == pytest.approx(6.0 * 1.5, abs=0.01)  # the spread is taken from the skewed centre


def test_unset_parameters_do_nothing(spark):
    wild = {"abs_mid_ret": 0.9, "market_spread_bps": 500.0, "drawdown": -1e9, "signed_volume": 1e7, "signed_volume_window": -1e7, "imbalance": 0.99, "micro_pos": -40.0, "micro_bias_bps": 80.0, "unwind_candidate": True}
    got = quotes(spark, {"quiet": ({}, BASE), "wild": (wild, BASE)})
    same = ["bid_px", "ask_px", "bid_size", "ask_size", "halt", "stop_triggered", "pull_triggered", "boost_triggered", "halt_triggered"]
    assert [got["wild"][c] for c in same] == [got["quiet"][c] for c in same]


MIRRORED = {
    "pull": ({"market_spread_bps": 6.5, "signed_volume": 42.0}, dict(BASE, pull_when_market_spread_bps_gt=6.0, pull_mode="one_side", pull_spread_add_bps=7.0, pull_size_factor=0.2)),
    "imbalance": ({"imbalance": 0.8}, dict(BASE, imbalance_thr=0.7, imbalance_size_factor=0.3)),
    "micro": ({"micro_pos": 0.06}, dict(BASE, micro_pos_thr=0.05, micro_pos_size_factor=0.4)),
    "bias": ({"micro_bias_bps": 1.9}, dict(BASE, micro_bias_thr_bps=1.8, micro_bias_size_factor=0.6)),
    "held": ({"position": 2.25}, dict(BASE, inventory_skew_bps=3.0)),
    "after": ({"position": 2.25, "market_spread_bps": 0.1, "unwind_candidate": True}, dict(BASE, pull_when_market_spread_bps_gt=9.0, post_pull_unwind_enable=True, post_pull_unwind_until_abs_pos_lt=1.5, post_pull_unwind_spread_add_bps=-1.0, post_pull_unwind_size_factor=1.5, post_pull_unwind_other_side_size_factor=0.25)),
}
SIGNED = ("position", "signed_volume", "signed_volume_window", "imbalance", "micro_pos", "micro_bias_bps")


def test_rules_are_the_same_for_both_sides(spark):
    """With all signs changed, bid and ask change places."""
    cases = dict(MIRRORED)
    cases |= {f"-{n}": ({k: -x if k in SIGNED else x for k, x in s.items()}, p) for n, (s, p) in MIRRORED.items()}
    got = quotes(spark, cases)
    for name in MIRRORED:
        a, b = got[name], got[f"-{name}"]
        assert sizes(a) == pytest.approx(sizes(b)[::-1]) and away(a) == pytest.approx(away(b)[::-1], abs=0.01), name


def test_the_side_that_a_rule_acts_on(spark):
    got = quotes(spark, MIRRORED)
    assert got["pull"]["pull_side"] == "sell" and sizes(got["pull"]) == (3.0, pytest.approx(0.6)) and away(got["pull"]) == pytest.approx((4.0, 11.0))
    assert sizes(got["imbalance"]) == (3.0, pytest.approx(0.9)) and sizes(got["micro"]) == (3.0, pytest.approx(1.2)) and sizes(got["bias"]) == (3.0, pytest.approx(1.8))
    assert got["after"]["post_pull_unwind_active"] and sizes(got["after"]) == (0.75, 4.5) and away(got["after"]) == pytest.approx((4.0, 3.0))


TRIGGERS = {  # parameter: (state that just fires, state that just doesn't, flag)
    "halt_when_abs_mid_ret_gt": (0.031, 0.03, "abs_mid_ret", "halt_triggered"),
    "halt_when_market_spread_bps_gt": (8.1, 8.0, "market_spread_bps", "halt_triggered"),
    "halt_when_market_spread_bps_lt": (1.9, 2.0, "market_spread_bps", "halt_triggered"),
    "stop_when_abs_mid_ret_gt": (0.031, 0.03, "abs_mid_ret", "stop_triggered"),
    "stop_when_market_spread_bps_gt": (8.1, 8.0, "market_spread_bps", "stop_triggered"),
    "stop_when_market_spread_bps_lt": (1.9, 2.0, "market_spread_bps", "stop_triggered"),
    "pull_when_abs_mid_ret_gt": (0.031, 0.03, "abs_mid_ret", "pull_triggered"),
    "pull_when_abs_signed_volume_gt": (-77.1, -77.0, "signed_volume", "pull_triggered"),
    "boost_when_abs_mid_ret_gt": (0.031, 0.03, "abs_mid_ret", "boost_triggered"),
}


def test_triggers_fire_beyond_their_threshold_only(spark):
    cases = {}
    for name, (on, off, field, _) in TRIGGERS.items():
        p = dict(BASE, **{name: abs(off)})
        cases |= {f"{name} on": ({field: on}, p), f"{name} off": ({field: off}, p)}
    got = quotes(spark, cases)
    for name, (_, _, _, flag) in TRIGGERS.items():
        assert (got[f"{name} on"][flag], got[f"{name} off"][flag]) == (True, False), name


def test_halts_stops_and_boosts(spark):
    jump, cut = {"abs_mid_ret": 0.2}, {"abs_mid_ret": 0.2, "position": 1.75}
    got = quotes(
        spark,
        {
            "halt": (jump, dict(BASE, halt_when_abs_mid_ret_gt=0.1)),
            "smaller": (jump, dict(BASE, halt_when_abs_mid_ret_gt=0.1, halt_size_factor=0.125)),
            "loss": ({"drawdown": -40.0}, dict(BASE, stop_max_intraday_drawdown_usdc=-40.0)),
            "long out": ({"position": 8.5}, dict(BASE, stop_max_abs_position=2.0, stop_mode="unwind_only")),
            "short out": ({"position": -2.125}, dict(BASE, stop_max_abs_position=2.0, stop_mode="unwind_only")),
            "boost": (jump, dict(BASE, boost_when_abs_mid_ret_gt=0.1, boost_size_factor=2.5, boost_spread_add_bps=1.0)),
            "too long": (cut, dict(BASE, boost_when_abs_mid_ret_gt=0.1, boost_size_factor=2.5, boost_only_if_abs_pos_lt=1.75)),
            "waiting": ({}, dict(BASE, boost_when_abs_mid_ret_gt=0.1, quote_only_in_boost=True)),
            "pull cap": ({"market_spread_bps": 3.0, "position": 1.5}, dict(BASE, pull_when_market_spread_bps_gt=2.0, pull_window_max_abs_position=2.25)),
            "pull skew": ({"market_spread_bps": 3.0, "position": 2.0}, dict(BASE, inventory_skew_bps=1.0, pull_when_market_spread_bps_gt=2.0, pull_window_inventory_skew_mult=4.0)),
            "sold": ({"signed_volume_window": -30.5, "signed_volume": 0.0}, dict(BASE, pull_when_abs_signed_volume_gt=30.0, pull_signed_volume_window_s=9.0, ask_size_factor_when_sv_neg=0.1)),
            "bought": ({"signed_volume_window": 30.5, "signed_volume": 0.0}, dict(BASE, pull_when_abs_signed_volume_gt=30.0, pull_signed_volume_window_s=9.0, ask_size_factor_when_sv_neg=0.1)),
        },
    )
    assert got["halt"]["halt"] and sizes(got["halt"]) == (0.0, 0.0)
    assert not got["smaller"]["halt"] and sizes(got["smaller"]) == (0.375, 0.375)
    assert got["loss"]["stop_triggered"] and sizes(got["loss"]) == (None, None)
    assert got["long out"]["bid_size"] is None and (got["long out"]["ask_px"], got["long out"]["ask_size"]) == (MID, 3.0)
    assert got["short out"]["ask_size"] is None and (got["short out"]["bid_px"], got["short out"]["bid_size"]) == (MID, 2.125)
    assert sizes(got["boost"]) == (7.5, 7.5) and away(got["boost"]) == pytest.approx((5.0, 5.0))
    assert not got["too long"]["boost_triggered"] and sizes(got["too long"]) == (3.0, 3.0)
    assert got["waiting"]["halt"] and sizes(got["waiting"]) == (None, None)
    assert sizes(got["pull cap"]) == (0.75, 3.0)
    assert got["pull skew"]["skew_bps"] == pytest.approx(8.0)
    assert got["sold"]["ask_sv_neg_triggered"] and sizes(got["sold"]) == (3.0, pytest.approx(0.3))
    assert not got["bought"]["ask_sv_neg_triggered"] and got["bought"]["pull_triggered"] and sizes(got["bought"]) == (3.0, 3.0)


def test_unknown_parameter_is_refused():
    with pytest.raises(ValueError):
        qt.parameter_columns(base_spread=1.0)
