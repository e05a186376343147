"""Run logs from files, and streams against their batch forms."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tideblock.operators import blocks as bl
from tideblock.operators import runlogs as rl
from tideblock.sources import logs, sinks
from tideblock.streaming import market as sm
from tideblock.streaming import sinks as ss
from tideblock.streaming import state as st

T0 = 1_700_000_000_000


def write_run(folder, **files):
    folder.mkdir(parents=True)
    for name, rows in files.items():
        lines = [r if isinstance(r, str) else json.dumps(r) for r in rows]
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")


def test_fills_of_a_run_with_market_orders_and_decisions(spark, tmp_path):
    """Three fills: one matched with an order, one of an unknown order, one without an id before any decision."""
    write_run(
        tmp_path / "alpha",
        market_state=[{"ts_ms": T0, "best_bid": 40.0, "best_ask": 42.0, "spread_filter_active": True}, {"ts_ms": T0 + 8_000, "best_bid": 43.0, "best_ask": 43.5}, {"ts_ms": T0 + 20_000, "markPx": 45.0}],
        decision=[{"ts_ms": T0 + 5_000, "boost_triggered": True, "final_bid_px": 41.0, "final_ask_px": 44.0}, {"ts_ms": T0 + 9_000, "boost_active": False, "boost_triggered": True, "final_bid_px": 43.0, "final_ask_px": 44.0}],
        orders=[{"ts_ms": T0 + 6_000, "action": "new", "cloid": "", "client_oid": "k-5", "effective_spread_bps": 12.5}, "{broken", "[1]"],
        fills=[
            {"time": T0 + 2_000, "side": "A", "px": 41.5, "sz": 2.0, "fee": 0.0083, "crossed": True},
            {"time": T0 + 8_500, "side": "B", "px": 43.0, "sz": 4.0, "fee": -0.0172, "crossed": False, "cloid": "", "client_oid": "k-5"},
            {"time": T0 + 12_000, "side": "A", "px": 44.0, "sz": 1.0, "fee": 0.0, "crossed": False, "cloid": "k-9"},
        ],
        events=[{"ts_ms": T0, "type": "info"}],
    )
    write_run(tmp_path / "beta", market_state=[{"ts_ms": T0, "best_bid": 7.0, "best_ask": 7.5}])
    log = {n: logs.read_run_log(spark, str(tmp_path), n) for n in ("market_state", "decision", "orders", "fills", "events")}
    assert log["orders"].count() == 1 and log["market_state"].count() == 4
    with pytest.raises(Exception):
        logs.read_run_log(spark, str(tmp_path), "orders", strict=True).collect()
    fills = rl.enrich_fills(log["fills"], log["market_state"], log["orders"], log["decision"])
    first, second, third = fills.orderBy("ts_ms").collect()
    assert [(f.run_id, f.mid, f.mid_source, f.join_dt_ms) for f in (first, second)] == [("alpha", 41.0, "best_bid_ask", 2_000), ("alpha", 43.25, "best_bid_ask", 500)]
    assert [f.edge_bps for f in (first, second)] == [pytest.approx((41.5 - 41.0) / 41.0 * 1e4), pytest.approx((43.25 - 43.0) / 43.25 * 1e4)]
    assert [f.fee_bps for f in (first, second)] == [pytest.approx(0.0083 / 83 * 1e4), pytest.approx(-0.0172 / 172 * 1e4)]
    assert [f.order_match for f in (first, second, third)] == ["missing", "matched", "unmatched"]
    assert (second.order_dt_ms, second.ord.effective_spread_bps) == (2_500, 12.5)
    assert [f.boost_key for f in (first, second, third)] == ["unknown", "boost", "base"]
    late = {f.ts_ms - T0: f.markout_bps for f in rl.fill_markouts(fills, rl.market_mids(log["market_state"]), [5]).collect()}
    assert late[2_000] == pytest.approx((41.5 - 43.25) / 43.25 * 1e4) and late[8_500] == pytest.approx((45 - 43) / 45 * 1e4)


def test_quote_gaps(spark, many_chunks):
    flags = [(0, True, False), (10, False, False), (20, False, True), (35, True, None), (50, False, True), (60, None, None)]
    rows = spark.createDataFrame(
        [("r", t, i, "open_orders_sync", None, b, a) for i, (t, b, a) in enumerate(flags)] + [("r", 70, 9, "other", None, None, None)],
        "run_id string, ts_ms bigint, seq bigint, event string, type string, open_bid_present boolean, open_ask_present boolean",
    )
    got = sorted((r.side_key, r.start_ms, r.gap_ms) for r in rl.quote_gaps(rows).collect())
    assert got == [("buy", 10, 25), ("buy", 50, 20), ("sell", 0, 20)]


def test_reports_and_metrics_files(spark, tmp_path):
    for run, doc in (("a", {"net_bps": {"median": 1.5, "p10": -1.0}, "fills_count": 12, "markout_bps": {"30": {"median": -6.0}}}), ("_monitor", {}), ("b", "not json")):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run_report.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1))
        (tmp_path / "runs" / run / "metrics.json").write_text(json.dumps({"pnl": 2.0, "inventory": {"mean": 0.5}}, indent=1))
    rows = logs.read_run_reports(spark, str(tmp_path / "runs")).filter(F.col("fills_count").isNotNull()).collect()
    assert [(r.run_id, r.net_med, r.net_p10, r.markout30_med) for r in rows] == [("a", 1.5, -1.0, -6.0)]
    m = logs.read_metrics(spark, str(tmp_path / "runs")).select("run_id", logs.metric_at("inventory.mean").alias("x")).collect()
    assert {(r.run_id, r.x) for r in m} == {("a", 0.5), ("b", 0.5)}
    sinks.write_tsv(spark.createDataFrame([("a", 1)], "run string, n bigint"), str(tmp_path / "tsv"))
    assert "run\tn" in "".join(p.read_text() for p in (tmp_path / "tsv").glob("*.csv"))


def append(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


BLOCKS = "symbol string, block_ts_ms bigint, book_event_id bigint, bid_px double, bid_sz double, ask_px double, ask_sz double, signed_volume_lenient double"


def block(i: int, symbol: str, ts: int, flow: float) -> tuple:
    bid = None if i % 13 == 5 else 100.0 + i // 8 % 3
    return (symbol, ts, i, bid, 1.0 + i // 2 % 2, None if bid is None else bid + 1, 2.0, flow)


def test_block_state_over_ten_batches_equals_batch(spark, tmp_path):
    """Half of all rows under one symbol, a gap, flows of 17 digits before small ones, late and repeated blocks, a repeated batch."""
    rows = [block(i, "hot" if i % 2 else f"S{i % 6}", i * 1000 + (40_000 if i > 60 else 0), 1e17 if i in (11, 12) else float(i % 5 - 2) / 8) for i in range(120)]
    handler = st.BlockState(spark, str(tmp_path / "state"), 30_000, 6000)
    for n in range(10):
        part = rows[n * 12 : n * 12 + 12]
        if n == 5:
            part = part + [block(999, "hot", 1000, 1.0), rows[50], rows[51]]
        batch = spark.createDataFrame(part, BLOCKS).repartition(3)
        handler.handle(batch, n)
        if n in (0, 4):
            handler.handle(batch, n)
    got = {r.book_event_id: r for r in handler.emitted("rows").collect()}
    want = bl.rolling_sum(bl.market_state(spark.createDataFrame(rows, BLOCKS), reconnect_gap_ms=30_000), "signed_volume_lenient", 6000).collect()
    assert len(got) == len(want) == 120 == handler.emitted("rows").count()
    for w in want:
        g = got[w.book_event_id]
        assert all(g[c] == w[c] for c in st.BLOCK_STATE)
    assert sum(r.book_change != r.top_px_change for r in got.values()) > 10
    assert sorted(r.book_event_id for r in handler.emitted("late").collect()) == [50, 51, 999]


def test_block_state_forgets_silent_symbols(spark, tmp_path):
    handler = st.BlockState(spark, str(tmp_path / "state"), 10**9, 1000, timeout_ms=5000)
    for n, part in enumerate([[block(1, "A", 0, 1.0), block(2, "B", 0, 1.0)], [block(3, "B", 6000, 1.0)], [block(4, "A", 7000, 1.0), block(6, "B", 7000, 1.0)]]):
        handler.handle(spark.createDataFrame(part, BLOCKS), n)
    got = {r.book_event_id: (r.mid_ret is None, r.reconnect) for r in handler.emitted("rows").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (True, False), 6: (False, False)}


def test_duplicates_across_batches_late_rows_and_rows_without_a_key(spark, tmp_path):
    handler = st.Dedupe(spark, str(tmp_path / "d"), ["symbol", "trade_id"], ["ts_ms", "event_id"], 100)
    batches = [
        [("S", "a", 10, 1), ("S", "a", 10, 2), ("S", "b", 20, 3), ("T", "a", 10, 4), ("S", None, 15, 5)],
        [("S", "b", 150, 6), ("S", "c", 150, 7), ("S", "a", 30, 8)],  # the clock is at 20: nothing is late yet
        [("S", "d", 40, 9), ("S", "b", 60, 10), ("S", "e", 300, 11), (None, "e", 1, 12)],  # the watermark is at 50
        [("S", "c", 210, 13), ("S", "f", 199, 14), ("S", "b", 400, 15)],  # at 200; b of 20 has been forgotten
    ]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "symbol string, trade_id string, ts_ms bigint, event_id bigint")
        for _ in range(1 + n % 2):
            handler.handle(df, n)
    ids = lambda name: sorted(r.event_id for r in handler.emitted(name).collect())
    assert ids("rows") == [1, 3, 4, 7, 11, 15]
    assert ids("late") == [9, 14] and ids("without_key") == [5, 12]


def test_fills_keep_waiting_for_their_mid(spark, tmp_path):
    """Fills and mids in six batches; fills whose mid is missing come with a null, and each comes once."""
    fills = [("S" if i % 4 else "U", i, "buy" if i % 2 else "sell", 100.0, i * 1000) for i in range(40)]
    mids = [("S", i, 100.0 + i, i * 700) for i in range(70) if not 20 <= i < 32]
    fill_schema, mid_schema = "symbol string, fill_id bigint, side string, px double, ts_ms bigint", "symbol string, event_id bigint, mid double, ts_ms bigint"
    both = st.markout_input(spark.createDataFrame(fills, fill_schema), spark.createDataFrame(mids, mid_schema)).collect()
    handler = st.FillMarkout(spark, str(tmp_path / "m"), 5000, 2000, 1000)
    schema = "symbol string, kind string, ts_ms bigint, id bigint, side string, px double"
    for n in range(6):
        part = [r for r in both if n * 9000 <= r.ts_ms < n * 9000 + 9000] + ([("S", "fill", 100, 777, "buy", 1.0)] if n == 3 else [])
        batch = spark.createDataFrame(part, schema)
        handler.handle(batch, n)
        if n == 2:
            handler.handle(batch, n)
        waiting = spark.read.parquet(f"{tmp_path}/m/waiting/batch={n}").count()
        kept = spark.read.parquet(f"{tmp_path}/m/mids/batch={n}").count()
        assert waiting <= 20 and kept <= 20
    handler.handle(spark.createDataFrame([(None, None, 10**7, None, None, None)], schema), 6)
    rows = handler.emitted("rows").collect()
    got, want = {r.fill_id: r.markout for r in rows}, {}
    for symbol, i, side, px, t in fills:
        hits = [x for x in mids if symbol == "S" and t + 5000 <= x[3] <= t + 7000]
        mid = min(hits, key=lambda x: x[3])[2] if hits else None
        want[i] = None if mid is None else mid - px if side == "buy" else px - mid
    assert len(rows) == 40 and got == want
    assert 10 < sum(x is None for x in want.values()) < 25
    assert [r.id for r in handler.emitted("late").collect()] == [777]


def test_monitor_readers_follow_published_versions(spark, tmp_path):
    schema = "run_id string, mtime bigint, fills_count int, notional_sum double, fills_joined_count int, net_med double, net_p10 double, markout30_med double, taker_guard_trip boolean, taker_notional_share double"
    report = lambda run, mtime, net: (run, mtime, 100, 1e6, 5, net, -0.5, 1.0, False, 0.0)
    monitor = st.RunMonitor(spark, str(tmp_path / "monitor"))
    assert monitor.published() is None
    parts = [[report("a", 1, 1.0), report("b", 2, -1.0)], [report("a", 3, 3.0), report("b", 1, 9.0)], [report("c", 4, 5.0), report("a", 3, 4.0)]]
    batches = [spark.createDataFrame(p, schema) for p in parts]
    monitor.handle(batches[0], 0)
    first = monitor.rollup()  # a reader that stays with its version
    for n in (1, 1, 2):
        monitor.handle(batches[n], n)
    monitor.handle(batches[0], 0)  # published long ago
    assert first.first().net_med_median == 0.0 and monitor.published() == 2
    assert {r.run_id: r.net_med for r in monitor.statuses().collect()} == {"a": 4.0, "b": -1.0, "c": 5.0}
    assert (monitor.rollup().first().runs, monitor.rollup().first().net_med_median) == (3, 4.0)


def test_replay_cuts_a_table_into_slices_of_its_size(spark):
    seen = []
    df = spark.range(1000).select(F.col("id"), (F.col("id") * F.col("id")).alias("ts_ms"))

    def handle(batch, n):
        r = batch.agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()
        seen.append(tuple(r))

    ss.replay_into(df, "ts_ms", handle, rows_per_batch=100)
    assert sum(r[0] for r in seen) == 1000 and len(seen) == 10 and max(r[0] for r in seen) < 150
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_every_query_is_registered_without_a_session():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 160
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["e16_mean_markout_by_symbol", "d18_edge_screen", "c16_j2_fill_upper", "e8_c17_position_ledger", "d9_window_split_pnl"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry
    from compare import connect, differences

    folder = entry.SMALL
    n, bad = differences(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name])
    assert n > 0 and not bad, bad
