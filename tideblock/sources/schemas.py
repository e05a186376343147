"""Explicit schemas of every file kind; nothing is inferred."""

# All field names and types below are those of the files.

from __future__ import annotations

RAW_EVENT = """
channel STRING, type STRING, symbol STRING, recv_ts_ms BIGINT, ts_ms BIGINT, event_id STRING,
bids ARRAY<ARRAY<STRING>>, asks ARRAY<ARRAY<STRING>>, levels ARRAY<ARRAY<STRUCT<px: STRING, sz: STRING>>>,
bid_px STRING, bid_sz STRING, ask_px STRING, ask_sz STRING, px STRING, sz STRING, side STRING, trade_id STRING,
status STRING, metadata STRING, fee STRING, amount STRING, rate STRING, funding_id STRING, _corrupt STRING
"""

# The wire also has T, the last millisecond; names differing only in case cannot share a schema, so it is derived.
CANDLE = "t BIGINT, s STRING, i STRING, o STRING, c STRING, h STRING, l STRING, v STRING, n BIGINT"

NODE_TRADE = "coin STRING, side STRING, time STRING, px STRING, sz STRING, hash STRING, tid BIGINT"

MARKET_LOG = """
ts_ms BIGINT, best_bid DOUBLE, best_ask DOUBLE, mid DOUBLE, mark_px DOUBLE, markPx DOUBLE, mid_ret DOUBLE,
abs_mid_ret DOUBLE, market_spread_bps DOUBLE, spread_bps DOUBLE, signed_volume DOUBLE, signed_volume_window DOUBLE,
book_hash8 STRING, spread_filter_active BOOLEAN, boost_active BOOLEAN, reconnect BOOLEAN, top_px_change BOOLEAN,
mid_change BOOLEAN, book_change BOOLEAN
"""

DECISION_LOG = """
ts_ms BIGINT, boost_active BOOLEAN, boost_triggered BOOLEAN, halt_triggered BOOLEAN, stop_triggered BOOLEAN,
pull_triggered BOOLEAN, spread_filter_active BOOLEAN, raw_bid_sz DOUBLE, raw_ask_sz DOUBLE, final_bid_px DOUBLE,
final_ask_px DOUBLE, final_bid_sz DOUBLE, final_ask_sz DOUBLE, base_size DOUBLE, crossed BOOLEAN
"""

ORDER_LOG = """
ts_ms BIGINT, action STRING, client_oid STRING, cloid STRING, clientOid STRING, oid STRING, batch_id STRING, side STRING,
px DOUBLE, sz DOUBLE, status STRING, error STRING, reason STRING, effective_spread_bps DOUBLE,
reject_backoff_active BOOLEAN, risk_escape_triggered BOOLEAN, risk_escape_applied BOOLEAN, risk_escape_bucket STRING,
risk_escape_mode STRING, risk_escape_delta_ticks DOUBLE, risk_size_down_applied BOOLEAN,
risk_escape_global_lag_quiet_trigger BOOLEAN, send_latency_ms DOUBLE, pre_send_book_age_ms DOUBLE,
pre_send_recv_age_ms DOUBLE, pre_send_marketable BOOLEAN, pre_send_spread_ticks DOUBLE, pre_send_round_mode STRING
"""

EVENT_LOG = """
ts_ms BIGINT, event STRING, type STRING, reason STRING, side STRING, bucket STRING, decision STRING,
cancel_needed BOOLEAN, skip_reason STRING, cooldown_ms DOUBLE, open_bid_present BOOLEAN, open_ask_present BOOLEAN,
last_open_orders_sync_ts BIGINT, pre_send_recv_age_ms DOUBLE
"""

FILL_LOG = """
time DOUBLE, ts_ms BIGINT, side STRING, px DOUBLE, sz DOUBLE, fee DOUBLE, crossed BOOLEAN, cloid STRING,
client_oid STRING, clientOid STRING, tid STRING, tradeId STRING, hash STRING, coin STRING, oid STRING
"""

RUN_LOGS = {
    "market_state": MARKET_LOG,
    "decision": DECISION_LOG,
    "orders": ORDER_LOG,
    "events": EVENT_LOG,
    "fills": FILL_LOG,
}

_SUMMARY = "STRUCT<count: BIGINT, mean: DOUBLE, p10: DOUBLE, p25: DOUBLE, median: DOUBLE, p75: DOUBLE, p90: DOUBLE, p99: DOUBLE>"

RUN_REPORT = f"""
run_id STRING, run_dir STRING, fills_count BIGINT, notional_sum DOUBLE, fills_joined_count BIGINT,
net_bps {_SUMMARY}, markout_bps MAP<STRING, {_SUMMARY}>, taker_guard_trip BOOLEAN, taker_notional_share DOUBLE
"""

METRICS = """
num_blocks BIGINT, num_fills BIGINT, notional_traded DOUBLE, fill_rate DOUBLE, pnl DOUBLE, max_drawdown DOUBLE,
stop_trigger_count BIGINT, pull_trigger_count BIGINT, halt_trigger_count BIGINT, stop_trigger_rate DOUBLE,
pull_trigger_rate DOUBLE, halt_trigger_rate DOUBLE, realized_spread_1s DOUBLE, realized_spread_5s DOUBLE,
realized_spread_15s DOUBLE, markout_1s DOUBLE, markout_5s DOUBLE, markout_15s DOUBLE,
inventory STRUCT<mean: DOUBLE, p10: DOUBLE, p90: DOUBLE, p95: DOUBLE, max_abs: DOUBLE>,
fee_breakdown STRUCT<fees: DOUBLE, rebates: DOUBLE, funding: DOUBLE>
"""

ACCOUNT_STATE = """
ts_ms BIGINT, marginSummary STRUCT<accountValue: STRING, totalMarginUsed: STRING, totalNtlPos: STRING, totalRawUsd: STRING>,
crossMarginSummary STRUCT<accountValue: STRING, totalMarginUsed: STRING, totalNtlPos: STRING, totalRawUsd: STRING>,
withdrawable STRING, assetPositions ARRAY<STRUCT<position: STRUCT<coin: STRING, szi: STRING, entryPx: STRING, unrealizedPnl: STRING>>>
"""
