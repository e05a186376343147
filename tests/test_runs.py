"""Ledgers, run metrics, order evaluation, latch, research and gates against plain Python."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideblock.operators import gates as gt
from tideblock.operators import orderfills as of
from tideblock.operators import positions as ps
from tideblock.operators import research as rs
from tideblock.operators import runs as rn

FILLS = "run_id string, ts_ms bigint, trade_id string, side string, px double, sz double, fee double"
FUNDS = "run_id string, ts_ms bigint, funding_id string, amount double"


def fold(fills, fundings, reset):
    """Position, average cost and realised pnl after each fill, one key."""
    pos, avg, real, fee, out = Decimal(0), None, 0.0, 0.0, {}
    for _, ts, tid, side, px, sz, f in sorted(fills, key=lambda r: (r[1], r[2])):
        s = Decimal(str(sz)) * (1 if side == "buy" else -1)
        if pos == 0:
            avg = px
        elif pos * s > 0:
            avg = (float(pos) * avg + float(s) * px) / float(pos + s)
        else:
            real += (px - avg) * float(min(abs(pos), abs(s))) * (1 if pos > 0 else -1)
            if pos + s == 0:
                avg = None
            elif reset or abs(s) > abs(pos):
                avg = px
        pos += s
        fee -= f
        paid = sum(a for _, t, _, a in fundings if t <= ts)
        out[tid] = (float(pos), avg, real, fee, paid)
    return out


@pytest.mark.parametrize("reset", [True, False])
def test_position_ledger_equals_a_fold(spark, many_chunks, reset):
    rng = random.Random(5)
    fills = [
        (rng.choice("AAAB"), rng.randrange(80), f"{i:03d}", rng.choice(["buy", "sell"]), float(rng.randrange(90, 110)), rng.choice([0.1, 0.2, 1.0, 3.0]), 0.01)
        for i in range(160)
    ]
    funds = [(rng.choice("AB"), rng.randrange(120), f"f{i}", rng.choice([0.5, -0.25])) for i in range(20)]
    build = ps.position_ledger if reset else ps.average_cost_ledger
    rows = build(spark.createDataFrame(fills, FILLS), spark.createDataFrame(funds, FUNDS), ["run_id"]).collect()
    late = [r for r in rows if r.trade_id is None]
    want = {}
    for k in "AB":
        mine, paid = [f for f in fills if f[0] == k], [f for f in funds if f[0] == k]
        want.update(fold(mine, paid, reset))
        last = max(f[1] for f in mine)
        assert len([r for r in late if r.run_id == k]) == len([f for f in paid if f[1] > last])
    assert len(rows) - len(late) == len(fills)
    for r in rows:
        if r.trade_id is not None:
            pos, avg, real, fee, paid = want[r.trade_id]
            assert (r.position, r.price_pnl, r.fees, r.funding) == (pos, pytest.approx(real), pytest.approx(fee), pytest.approx(paid))
            assert r.avg_cost == (None if avg is None else pytest.approx(avg))
        assert r.total_pnl == pytest.approx(r.price_pnl + r.fees + r.funding + r.unrealized_pnl)


def test_order_evaluation(spark):
    trades = spark.createDataFrame(
        [("S", "b", 1, "1", "buy", 64.75, 2.0), ("S", "b", 2, "2", "sell", 64.25, 3.0), ("S", "b", 3, "3", "sell", 65.5, 1.0), ("S", "b", 4, "4", "sell", 60.5, 4.0)],
        "symbol string, book_event_id string, ts_ms bigint, event_id string, side string, px double, sz double",
    )
    orders = spark.createDataFrame(
        [("a", "buy", 9.0, 64.75), ("b", "sell", 9.0, 64.75), ("c", "buy", 9.0, 50.0), ("d", "buy", 9.0, 64.25)], "order_id string, side string, size double, price double"
    ).selectExpr("*", "'S' symbol", "'b' book_event_id", "60.0D bid_px", "66.0D ask_px", "true post_only")
    limited = of.with_limit(orders)
    up = {r.order_id: r for r in of.evaluate(limited, trades).collect()}
    assert (up["a"].fill_size, up["a"].fill_price, up["a"].trades_used) == (7.0, pytest.approx((3 * 64.25 + 4 * 60.5) / 7), 2)
    assert (up["b"].fill_size, up["b"].fill_price) == (2.0, 64.75)
    assert up["c"].fill_size is None and up["d"].fill_size == 7.0
    low = {(r.order_id, r.alpha): r for r in of.evaluate(limited, trades, model="lower", alpha=[0.3, 0.5], prints=1).collect()}
    assert (low["a", 0.5].fill_size, low["a", 0.5].fill_price) == (1.5, 64.25)
    assert all(low[o, al].fill_size is None or low[o, al].fill_size <= up[o].fill_size for o, al in low)
    top = {r.order_id: r for r in of.evaluate(limited, trades, at_limit=True).collect()}
    assert (top["c"].fill_size, top["c"].fill_price) == (9.0, 50.0)
    crossing = orders.withColumn("price", F.lit(66.0)).filter("order_id = 'a'")
    assert of.order_status(of.evaluate(of.with_limit(crossing), trades)).first().status == "invalid_cross"
    assert {r.order_id: r.status for r in of.order_status(of.evaluate(limited, trades)).collect()} == {"a": "filled", "b": "filled", "c": "no_fill", "d": "filled"}


@pytest.mark.parametrize("limit, above, below", [("1000000000.5", "1000000000.500000000000000001", "1000000000.499999999999999999"), ("0.123456789012345", "0.123456789012346", "0.123456789012344")])
def test_limits_are_compared_with_all_decimals(spark, limit, above, below):
    kinds = "symbol string, book_event_id string, ts_ms bigint, event_id string, side string, px string, sz double"
    trades = spark.createDataFrame([("Q", "k", 1, "1", "sell", above, 2.0), ("Q", "k", 2, "2", "sell", limit, 3.0), ("Q", "k", 3, "3", "sell", below, 4.0)], kinds)
    orders = spark.createDataFrame([("o", "Q", "k", "buy", limit)], "order_id string, symbol string, book_event_id string, side string, limit_px string")
    exact = "decimal(38,18)"
    hit = of.eligible_volume(orders.withColumn("limit_px", F.col("limit_px").cast(exact)), trades.withColumn("px", F.col("px").cast(exact))).first()
    assert (hit["_volume"], hit["_count"]) == (7.0, 2)


@pytest.mark.parametrize("prints", [1, 3])
def test_first_prints_equal_a_search(spark, many_chunks, prints):
    """Blocks of many levels, equal prices and times, orders without a side or a limit."""
    rng = random.Random(prints)
    trades = [("S", f"b{rng.randrange(3)}", rng.randrange(50), i, rng.choice(["buy", "sell", None]), rng.randrange(60) / 4, float(rng.randrange(0, 4))) for i in range(700)]
    orders = [(i, "S", f"b{rng.randrange(4)}", rng.choice(["buy", "sell", None, "hold"]), 2.0, None if i % 17 == 0 else rng.randrange(64) / 4) for i in range(300)]
    got = of.first_prints(
        spark.createDataFrame(orders, "order_id int, symbol string, book_event_id string, side string, size double, limit_px double"),
        spark.createDataFrame(trades, "symbol string, book_event_id string, ts_ms bigint, event_id bigint, side string, px double, sz double"), prints,
    ).collect()
    found = {r.order_id: (r["_volume"], r["_value"], r["_count"]) for r in got}
    assert len(found) == len(got) == len(orders)
    for i, _, block, side, _, limit in orders:
        hit = [t for t in trades if t[1] == block and t[6] > 0 and limit is not None and ((side == "buy" and t[4] == "sell" and t[5] <= limit) or (side == "sell" and t[4] == "buy" and t[5] >= limit))]
        hit = sorted(hit, key=lambda t: (t[2], t[3]))[:prints]
        want = (sum(t[6] for t in hit), sum(t[5] * t[6] for t in hit), len(hit)) if hit else (None, None, None)
        assert found[i] == want


def test_ten_thousand_orders_and_trades_of_one_block(spark):
    """10**8 pairs are not formed: every order of the block reaches thousands of trades."""
    base = spark.range(10_000).select(F.lit("S").alias("symbol"), F.lit("b").alias("book_event_id"), "id")
    trades = base.select("*", F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("ts_ms"), F.col("id").alias("event_id"), F.lit("sell").alias("side"), (100 + F.pmod(F.col("id") * 31, F.lit(10_000)) / 1000).alias("px"), F.lit(1.0).alias("sz"))
    orders = base.select("*", F.col("id").alias("order_id"), F.lit("buy").alias("side"), (100 + F.col("id") / 1000).alias("limit_px"))
    rows = of.first_prints(orders.drop("id"), trades.drop("id"), 5)
    got = {r.order_id: (r["_volume"], r["_count"]) for r in rows.select("order_id", "_volume", "_count").collect()}
    assert len(got) == 10_000 and all(got[i] == (float(min(i + 1, 5)), min(i + 1, 5)) for i in range(10_000))


def test_average_cost_after_very_many_partial_closes(spark, many_chunks):
    """Each close leaves a tenth: a plain product of the remainders of 600 closes and re-openings would be 1e-600."""
    fills, held = [], 0.0
    for i in range(600):
        fills += [("A", 2 * i, f"{2 * i:05d}", "buy", 100.0 + i % 7, 10.0 - held, 0.0), ("A", 2 * i + 1, f"{2 * i + 1:05d}", "sell", 101.0, 9.0, 0.0)]
        held = 1.0
    rows = ps.average_cost_ledger(spark.createDataFrame(fills, FILLS), spark.createDataFrame([], FUNDS), ["run_id"]).collect()
    want = fold(fills, [], False)
    assert len(rows) == 1200
    for r in rows:
        assert (r.position, r.avg_cost, r.price_pnl) == (want[r.trade_id][0], pytest.approx(want[r.trade_id][1]), pytest.approx(want[r.trade_id][2]))


def test_unwind_latch_equals_a_loop(spark, many_chunks):
    rng = random.Random(9)
    rows = [("S", i, i, rng.random() < 0.15, rng.random() < 0.05, rng.choice([0.0, 0.5, 1.0, -2.0, 3.0])) for i in range(300)]
    rows = [(a, b, c, p, (not p) and cl, inv) for a, b, c, p, cl, inv in rows]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, pull boolean, clears boolean, inv double")
    got = {r.i: r.post_pull_unwind_active for r in of.unwind_latch(df, ["k"], ["t", "i"], 0.5).collect()}
    prev_pull = active = False
    for _, _, i, pull, clears, inv in rows:
        active = (not pull) and (not clears) and (active or prev_pull) and abs(inv) > 0.5
        prev_pull = pull
        assert got[i] == active, i


def test_run_metrics(spark, many_chunks):
    ledger = spark.createDataFrame(
        [("r", 0, "a", 0.0, 0.0, True), ("r", 1000, "b", 1.0, 2.0, False), ("r", 2000, "c", -3.0, 1.0, True)],
        "run_id string, block_ts_ms bigint, book_event_id string, total_pnl double, position double, halt_triggered boolean",
    )
    fills = spark.createDataFrame([("r", "o", 1000, "b", "buy", 100.0, 2.0)], "run_id string, order_id string, block_ts_ms bigint, book_event_id string, side string, price double, size double")
    m = rn.run_basics(ledger, fills).first()
    assert (m.num_blocks, m.num_fills, m.notional_traded, m.fill_rate, m.pnl) == (3, 1, 200.0, pytest.approx(1 / 6), -3.0)
    assert rn.max_drawdown(ledger).first().max_drawdown == -4.0
    split = rn.pnl_when(ledger, ["halt_triggered"]).first()
    assert (split.pnl_in_halt_triggered, split.pnl_out_halt_triggered) == (-4.0, 1.0)
    mids = spark.createDataFrame([("r", 500, "x", 100.0), ("r", 1500, "y", 101.0)], "run_id string, mid_ts_ms bigint, mid_id string, mid double")
    out = rn.fill_outcomes(fills, mids, [500]).first()
    assert (out.markout, out.realized_spread) == (1.0, 1.0)
    windows = rn.overlapping_windows(ledger, 1000, 500).orderBy("window_no").collect()
    assert [w.start_ms for w in windows] == [0, 500, 1000]
    rows = rn.assign_windows(ledger, 1000, 500).collect()
    assert sorted((r.window_no, r.book_event_id) for r in rows) == [(0, "a"), (1, "b"), (2, "b")]
    prints = rn.same_as_baseline(rn.fingerprint(ledger.union(ledger.withColumn("run_id", F.lit("s"))).repartition(3), ["run_id"], ["block_ts_ms", "total_pnl"]), "r")
    assert all(r.same_as_baseline for r in prints.collect())


@pytest.mark.parametrize("buy, sell, size, pnl", [("0.000000003", "0.000000006", "1000000", 0.003), ("1000000", "1000001.5", "0.000000000000000002", 3e-18), ("123456789.123456789", "123456790.123456789", "100000", 1e5)])
def test_position_ledger_keeps_the_decimals_of_ingest(spark, buy, sell, size, pnl):
    deals = spark.createDataFrame([("r", 1, "a", "buy", buy, size), ("r", 2, "b", "sell", sell, size)], "run_id string, ts_ms bigint, trade_id string, side string, px string, sz string")
    deals = deals.withColumns({"px": F.col("px").cast("decimal(38,18)"), "sz": F.col("sz").cast("decimal(38,18)"), "fee": F.lit(0.0)})
    none = spark.createDataFrame([], "run_id string, ts_ms bigint, funding_id string, amount double")
    last = ps.position_ledger(deals, none, ["run_id"]).filter("ts_ms = 2").first()
    assert last.position == 0 and last.price_pnl == pytest.approx(pnl, rel=1e-6)


def test_a_hundred_windows_of_a_day(spark):
    day = 86_400_000
    rows = spark.createDataFrame([("r", 1_700_000_000_000 + k * day) for k in range(104)], "run_id string, block_ts_ms bigint")
    windows = rn.overlapping_windows(rows, 4 * day, day, ["run_id"]).orderBy("window_no").collect()
    assert [w.window_no for w in windows] == list(range(100)) and windows[-1].end_ms == 1_700_000_000_000 + 103 * day
    assigned = rn.assign_windows(rows, 4 * day, day, ["run_id"]).groupBy("window_no").count().collect()
    assert sorted((r.window_no, r["count"]) for r in assigned) == [(k, 4) for k in range(100)]
    assert rn.overlapping_windows(rows, 4 * day, day, ["run_id"], count=7).count() == 7
    assert rn.overlapping_windows(rows, 200 * day, day, ["run_id"]).count() == 0


def test_prints_are_compared_by_all_other_keys(spark):
    rows = spark.createDataFrame([(r, t, x) for r in "pq" for t, x in (("one", 1), ("two", 2))] + [("q", "two", 3)], "run_id string, kind string, x int")
    got = rn.same_as_baseline(rn.fingerprint(rows, ["run_id", "kind"], ["x"]), "p").collect()
    assert {(r.run_id, r.kind): r.same_as_baseline for r in got} == {("p", "one"): True, ("p", "two"): True, ("q", "one"): True, ("q", "two"): False}


def test_flow_markout_by_a_given_threshold(spark):
    outcomes = spark.createDataFrame([("r", b, "buy", 10.0, 1.0, m) for b, m in (("a", 1.0), ("b", 2.0), ("c", 4.0))], "run_id string, book_event_id string, side string, price double, size double, markout double")
    features = spark.createDataFrame([("r", "a", 1, 5.0), ("r", "b", 2, -5.0), ("r", "c", 3, 0.5), ("r", "c", 2, 9.0)], "run_id string, book_event_id string, block_ts_ms bigint, flow double")
    got = {r.flow: (r.n, r["mean"], r.threshold) for r in rn.flow_markout(outcomes, features, "flow", threshold=1.0).collect()}
    assert got == {"pos": (1, 1.0, 1.0), "neg": (1, 2.0, 1.0)}
    with pytest.raises(ValueError):
        rn.flow_markout(outcomes, features, "flow")


def test_targets_and_edge(spark, many_chunks):
    rows = spark.createDataFrame([("S", 0, "a", 100.0), ("S", 1000, "b", 110.0), ("S", 2000, "c", 120.0)], "symbol string, block_ts_ms bigint, book_event_id string, mid double")
    got = {r.book_event_id: r.y_markout_1s for r in rs.wide_targets(rows, [1]).collect()}
    assert got == {"a": 10.0, "b": 10.0, "c": None}
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=200), rng.normal(size=200)
    y = 0.3 * x + e
    data = [(i * 1000, i, float(x[i]), 1.0, float(-y[i]), float(y[i]), "train" if i < 150 else "test") for i in range(200)]
    df = spark.createDataFrame(data, "block_ts_ms bigint, book_event_id bigint, a double, flat double, neg double, y_ret_1s double, split string")
    out = {r.feature: r for r in rs.edge_screen(df, ["a", "flat", "neg"], "y_ret_1s").collect()}
    xt, yt = x[:150], y[:150]
    z = (xt - xt.mean()) / xt.std() * (yt - yt.mean()) / yt.std()
    d = z - z.mean()
    var = d @ d / 150 + 2 * sum((1 - k / 6) * (d[k:] @ d[:-k]) / 150 for k in range(1, 6))
    half = 1.96 * np.sqrt(max(var, 0) / 150)
    a = out["a"]
    assert (a.ic, a.ci_low, a.ci_high) == (pytest.approx(z.mean()), pytest.approx(z.mean() - half), pytest.approx(z.mean() + half))
    lo, hi = np.quantile(xt, 0.2), np.quantile(xt, 0.8)
    assert a.effect_bps == pytest.approx((yt[xt >= hi].mean() - yt[xt <= lo].mean()) * 1e4)
    assert (out["flat"].ic, out["flat"].keep, out["neg"].ic) == (pytest.approx(0.0), False, pytest.approx(-1.0))


def test_lags_cross_bucket_borders(spark, many_chunks, monkeypatch):
    monkeypatch.setattr(rs, "LAG_BUCKET", 8)
    rows = spark.createDataFrame([("k", i, float(i)) for i in range(50)], "k string, t bigint, v double")
    for r in rs.lagged(rows, ["k"], ["t"], "v", 5).collect():
        assert [r[f"lag_{i}"] for i in range(1, 6)] == [float(r.t - i) if r.t >= i else None for i in range(1, 6)]


def test_best_risk_window_equals_a_naive_search(spark, many_chunks):
    rng = random.Random(11)
    data = [(round(rng.gauss(0, 1), 1), rng.random() < 0.2, rng.choice([None, 1.0, -2.0])) for _ in range(400)]
    df = spark.createDataFrame([("f", *r) for r in data], "feature string, x double, risk boolean, delta double")
    got = rs.best_window(rs.threshold_windows(df, ["feature"], [i / 100 for i in range(1, 100)]), ["feature"]).first()
    x, risk = np.array([r[0] for r in data]), np.array([r[1] for r in data])
    best = None
    for i in range(1, 100):
        thr = float(np.quantile(x, i / 100))
        for mode in ("gt", "lt"):
            win = x >= thr if mode == "gt" else x <= thr
            tp = int((win & risk).sum())
            p, r = (tp / win.sum() if win.sum() else 0.0), tp / risk.sum()
            f1 = 2 * p * r / (p + r) if p + r else 0.0
            if best is None or f1 > best[0] + 1e-15:
                best = (f1, i / 100, mode, thr, win)
    assert (got.f1, got.p, got["mode"], got.threshold) == (pytest.approx(best[0]), best[1], best[2], pytest.approx(best[3]))
    inside = [r[2] for r, w in zip(data, best[4], strict=True) if w and r[2] is not None]
    assert got.mean_delta_in == pytest.approx(np.mean(inside))


def test_status_and_monitor(spark):
    rows = [("a", 12, 500.0, 12, 0.5, -1.0, -6.0, False, 0.0, 1), ("b", 12, 500.0, 12, -0.5, -1.0, -7.0, False, 0.0, 2), ("c", 3, 500.0, 3, 1.0, -1.0, 0.0, False, 0.0, 3),
            ("d", 12, 500.0, 12, 1.0, -9.0, 0.0, False, 0.0, 4), ("e", 12, 500.0, 12, 1.0, -1.0, 0.0, True, 0.0, 5)]
    df = spark.createDataFrame(rows, "run_id string, fills_count bigint, notional_sum double, fills_joined_count bigint, net_med double, net_p10 double, markout30_med double, taker_guard_trip boolean, taker_notional_share double, mtime bigint")
    status = gt.run_status(df)
    assert {r.run_id: r.status for r in status.collect()} == {"a": "PASS", "b": "FAIL", "c": "INCONCLUSIVE", "d": "HARD_FAIL", "e": "HARD_FAIL"}
    m = gt.monitor_rollup(status, 4).first()
    assert (m.runs, m.net_med_median, m.net_med_win_rate, m.warn_count, m.warn_consecutive, m.need_action, m.taker_guard_trips, m.verdict) == (4, 0.75, 0.75, 2, True, True, 1, "PASS")
