"""Market tables, run ledgers and run logs read from the given ``events`` table, in Spark and in SQL.

Every view covers the whole table. ``CTES`` holds the same rules as SQL text for the checks; ``with_ctes``
assembles the ones a statement needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.functions.values import micros_to_ms

HOUR_MS = 3_600_000
SYMBOLS, RUNS = 8, 20
VARIANTS = ["base", "cand_a", "cand_b"]
# Fixed texts of the derived order log.
ERROR_TEXTS = [
    "Post-only order would have immediately matched",
    "Too many cumulative requests sent",
    "Cannot modify canceled or filled order",
    "Insufficient margin to place order",
]
ACTIONS = ["new", "replace", "cancel", "cancel_all"]
EVENT_NAMES = [
    "open_orders_sync", "send_skip", "quote_skip", "replace_guard", "reject_backoff", "reject_backoff_clear",
    "dead_order_id_mark", "cancel_inflight_mark", "cancel_inflight_clear", "open_orders_error",
    "risk_escape_cancel_and_skip", "risk_escape_cancel_all_fallback", "risk_escape_skip",
]
GUARD_REASONS = ["recent_cancel_all", "order_id_missing_stage2", "dead_order_id", "cancel_inflight"]


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def base(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return raw.select(
        "event_id", "user_id", "event_type", "value", "ts",
        micros_to_ms(F.col("ts")).alias("ts_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("S"), (F.col("user_id") % SYMBOLS).cast("string")).alias("symbol"),
        F.concat(F.lit("R"), (F.col("user_id") % RUNS).cast("string")).alias("run_id"),
        F.round(100 + F.col("value") / 100, 4).alias("px0"),
    )


def books(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).filter(F.col("event_type").isin("view", "click"))
    full = F.col("k") > 0
    return b.select(
        "symbol", "run_id", "ts", "ts_ms", "event_id",
        F.when(full, F.round(F.col("px0") - 0.01 * (1 + F.col("event_id") % 5), 4)).alias("bid_px"),
        F.when(full, (1.0 + F.col("k")).cast("double")).alias("bid_sz"),
        F.when(full, F.round(F.col("px0") + 0.01 * (1 + F.col("event_id") % 7), 4)).alias("ask_px"),
        F.when(full, (1.0 + (F.col("k") * 7) % 100).cast("double")).alias("ask_sz"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).filter(F.col("event_type").isin("purchase", "error"))
    return b.select(
        "symbol", "run_id", "ts", "ts_ms", "event_id", F.col("event_id").cast("string").alias("trade_id"),
        F.when(F.col("event_type") == "purchase", F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        F.col("px0").alias("px"), (1.0 + F.col("k") % 10).cast("double").alias("sz"),
    )


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).filter(F.col("event_type") == "signup")
    return b.select(
        "symbol", "ts_ms", "event_id", F.when(F.col("k") < 50, F.lit("open")).otherwise(F.lit("halted")).alias("status"),
        (F.col("value") / 10).alias("oracle_gap"),
    )


def fundings(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).filter(F.col("event_type") == "signup")
    return b.select(
        "run_id", "symbol", "ts_ms", F.col("event_id").alias("funding_id"),
        ((F.col("k") - 50) / 1000.0).alias("amount"),
    )


def deals(spark: SparkSession, sf: str) -> DataFrame:
    """Own fills: every trade, with a fee."""
    return trades(spark, sf).withColumn("fee", F.col("sz") * 0.015)


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Three variants over the same blocks, one block per event."""
    b = base(spark, sf).select(
        "*", F.posexplode(F.array(*[F.lit(v) for v in VARIANTS])).alias("_no", "variant")
    ).withColumn("run_id", F.col("variant"))
    k, n = F.col("k"), F.col("_no")
    return b.select(
        "run_id", F.col("ts_ms").alias("block_ts_ms"), F.col("event_id").alias("book_event_id"),
        ((k - 50) / 10.0 * (1 + n)).alias("position"),
        F.when(k != 7, F.col("value") - 50 + n * (k - 49)).alias("total_pnl"),
        (F.col("value") * 0.5 + n).alias("price_pnl"),
        (k * 0.25 - n).alias("unrealized_pnl"),
        (-F.col("value") * 0.01).alias("fees"), (k * 0.001).alias("rebates"), ((k - 50) / 1000.0).alias("funding"),
        F.when(k != 3, F.col("px0")).alias("mark_price"),
        (1.0 + F.col("event_id") % 13 + k / 100.0).alias("market_spread_bps"),
        ((k - 50) * 1.0).alias("signed_volume"),
        F.abs((F.col("value") - 50) / 1e4).alias("abs_mid_ret"),
        (k + n < 6).alias("halt_triggered"), (k - n > 90).alias("pull_triggered"), (k + n == 50).alias("stop_triggered"),
        (k + n).between(10, 20).alias("boost_triggered"), (k + n).between(20, 35).alias("post_pull_unwind_active"),
    )


def run_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Fills of the three variants, in the block of their own event."""
    b = base(spark, sf).filter(F.col("event_type").isin("purchase", "error")).select(
        "*", F.posexplode(F.array(*[F.lit(v) for v in VARIANTS])).alias("_no", "variant")
    )
    return b.select(
        F.col("variant").alias("run_id"), F.col("event_id").alias("order_id"), F.col("ts_ms").alias("block_ts_ms"),
        F.col("event_id").alias("book_event_id"),
        F.when(F.col("event_type") == "purchase", F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        F.round(F.col("px0") + F.col("_no") * 0.01, 4).alias("price"), (1.0 + F.col("k") % 10).cast("double").alias("size"),
    )


def log_market(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    k, e = F.col("k"), F.col("event_id")
    return b.select(
        "run_id", "ts_ms", e.alias("seq"),
        F.when(k >= 5, F.round(F.col("px0") - 0.01 * (1 + e % 5), 4)).alias("best_bid"),
        F.when(k >= 5, F.round(F.col("px0") + 0.01 * (1 + e % 7), 4)).alias("best_ask"),
        F.when(k.isin(3, 4), F.col("px0")).alias("mid"), F.when(k > 0, F.col("px0")).alias("mark_px"),
        F.when(k != 9, k % 5 == 0).alias("spread_filter_active"), (k < 6).alias("boost_active"),
        (k == 99).alias("reconnect"), (k % 2 == 0).alias("top_px_change"),
    )


def log_decisions(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    k, e = F.col("k"), F.col("event_id")
    idle = k % 4 == 0
    return b.select(
        "run_id", "ts_ms", e.alias("seq"), (k >= 90).alias("boost_active"),
        F.when(~idle, 1.0 + k / 10.0).alias("raw_bid_sz"), F.when(~idle, 0.0 + k / 10.0).alias("raw_ask_sz"),
        (k % 8 == 0).alias("halt_triggered"), (k % 12 == 0).alias("stop_triggered"), (k % 5 == 0).alias("spread_filter_active"),
        F.when(k > 1, F.round(F.col("px0") - 0.01 * (1 + e % 3), 4)).alias("final_bid_px"),
        F.when(k > 1, F.round(F.col("px0") + 0.01 * (1 + e % 3), 4)).alias("final_ask_px"),
        F.lit(1.0).alias("base_size"), (1.0 + k / 100.0).alias("final_bid_sz"), (0.9 + k / 90.0).alias("final_ask_sz"),
        (k == 13).alias("crossed"),
    )


def log_orders(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    k, e = F.col("k"), F.col("event_id")
    return b.select(
        "run_id", "ts_ms", e.alias("seq"), _pick(ACTIONS, e).alias("action"),
        F.concat(F.lit(" c"), F.col("user_id").cast("string")).alias("client_oid"),
        F.when(k % 3 == 0, F.lit("buy")).when(k % 3 == 1, F.lit("sell")).alias("side"),
        F.when(k % 2 == 0, _pick(ERROR_TEXTS, F.floor(k / 2))).alias("error"),
        F.when(k % 7 == 0, F.lit("reconnect")).when(e % 4 == 2, F.lit("risk_escape_cancel_and_skip"))
        .when(e % 4 == 3, F.lit("risk_escape_cancel_and_skip_fallback")).alias("reason"),
        F.when(k % 5 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.round(1 + k / 16.0, 4).alias("effective_spread_bps"),
        (k % 4 == 1).alias("reject_backoff_active"), (k % 6 == 0).alias("risk_escape_triggered"),
        (k % 6 == 0).alias("risk_escape_applied"),
        F.when(k < 80, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("risk_escape_bucket"),
        F.when(k < 60, F.lit("Widen")).otherwise(F.lit("skip")).alias("risk_escape_mode"),
        (k % 9 == 0).alias("risk_size_down_applied"), (k % 11 == 0).alias("risk_escape_global_lag_quiet_trigger"),
        (k % 4).cast("double").alias("risk_escape_delta_ticks"),
        (F.col("value") - 5).alias("send_latency_ms"), (F.col("value") * 2).alias("pre_send_book_age_ms"),
        F.when(k != 11, F.col("value") * 3 - 10).alias("pre_send_recv_age_ms"),
        (k % 10 == 2).alias("pre_send_marketable"), F.when(k % 7 != 1, (k % 4) * 0.6).alias("pre_send_spread_ticks"),
        F.when(k % 5 != 0, F.concat(F.lit("m"), (k % 2).cast("string"))).alias("pre_send_round_mode"),
        F.floor(e / 3).alias("batch_id"),
    )


def log_fills(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf).filter(F.col("event_type").isin("purchase", "error"))
    # As a generated column ``k`` is parsed once; filters of price and size would else be pushed below the parsing, and each would parse again.
    b = b.select("event_id", "user_id", "event_type", "ts_ms", "run_id", "px0", F.inline(F.array(F.struct("k"))))
    k = F.col("k")
    return b.select(
        "run_id", (F.col("ts_ms") + (k - 50) * 1000).cast("double").alias("time"), F.lit(None).cast("bigint").alias("ts_ms"),
        F.col("event_id").alias("seq"),
        F.when(k == 44, F.lit("?")).when(F.col("event_type") == "purchase", F.lit("B")).otherwise(F.lit("A")).alias("side"),
        F.when(k != 17, F.col("px0")).alias("px"), (F.col("k") % 10).cast("double").alias("sz"),
        F.when(k != 21, (k % 10) * 0.015).alias("fee"), (k % 25 == 4).alias("crossed"),
        F.when(k % 8 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("cloid"),
    )


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    b = base(spark, sf)
    k, e = F.col("k"), F.col("event_id")
    name = _pick(EVENT_NAMES, e)
    guard = F.concat(
        F.when(k % 2 == 0, F.lit("replace->skip (")).otherwise(F.lit("replace->new (")), _pick(GUARD_REASONS, k), F.lit(")")
    )
    return b.select(
        "run_id", "ts_ms", e.alias("seq"), F.when(k % 2 == 0, name).alias("event"), F.when(k % 2 == 1, name).alias("type"),
        F.when(name == "replace_guard", guard)
        .when((name == "send_skip") & (k % 3 == 0), F.lit("pre_send_stale_book"))
        .when((name == "send_skip") & (k % 3 == 1), F.lit("pre_send_guard_all_skipped"))
        .when(name.isin("open_orders_sync", "open_orders_error") & (k < 50), F.lit("periodic"))
        .when(k % 3 == 0, F.lit("other")).alias("reason"),
        F.when(k % 3 == 0, F.lit("buy")).when(k % 3 == 1, F.lit("SELL")).alias("side"),
        F.when(k < 80, F.concat(F.lit("b"), (k % 3).cast("string"))).alias("bucket"),
        F.when(name == "risk_escape_cancel_all_fallback", F.when(k % 2 == 0, F.lit("cooldown_skip")).otherwise(F.lit("sent")))
        .when(k % 3 == 0, F.lit("skip_only")).when(k % 3 == 1, F.lit("cancel_enqueued")).alias("decision"),
        (k % 4 != 0).alias("cancel_needed"),
        F.when(k % 6 == 0, F.lit("no_order_on_side")).when(k % 6 == 3, F.lit("resync_failed")).alias("skip_reason"),
        F.when(k != 31, k * 10.0 - 20).alias("cooldown_ms"),
        F.when(k % 10 != 9, k % 3 != 0).alias("open_bid_present"), F.when(k % 10 != 8, k % 4 != 0).alias("open_ask_present"),
        F.when(k % 5 == 0, F.col("ts_ms") - k * 100).alias("last_open_orders_sync_ts"),
        (F.col("value") - 3).alias("pre_send_recv_age_ms"),
    )


def _sql_pick(words: list[str], index: str) -> str:
    listed = ", ".join("'" + w + "'" for w in words)
    return f"([{listed}])[(({index}) % {len(words)}) + 1]"


_NAME = _sql_pick(EVENT_NAMES, "event_id")
_VARIANTS = "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(VARIANTS)) + ") v(n, variant)"
_LOG_SIDE = "CASE k % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END"

CTES: dict[str, tuple[list[str], str]] = {
    "base": (
        [],
        f"""SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) // 1000 AS ts_ms,
          CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'S' || (user_id % {SYMBOLS}) AS symbol,
          'R' || (user_id % {RUNS}) AS run_id, round(100 + value / 100, 4) AS px0 FROM events""",
    ),
    "books": (
        ["base"],
        """SELECT symbol, run_id, ts, ts_ms, event_id,
          CASE WHEN k > 0 THEN round(px0 - 0.01::DOUBLE * (1 + event_id % 5), 4) END AS bid_px, CASE WHEN k > 0 THEN (1 + k)::DOUBLE END AS bid_sz,
          CASE WHEN k > 0 THEN round(px0 + 0.01::DOUBLE * (1 + event_id % 7), 4) END AS ask_px,
          CASE WHEN k > 0 THEN (1 + (k * 7) % 100)::DOUBLE END AS ask_sz
          FROM base WHERE event_type IN ('view', 'click')""",
    ),
    "trades": (
        ["base"],
        """SELECT symbol, run_id, ts, ts_ms, event_id, CAST(event_id AS VARCHAR) AS trade_id,
          CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side, px0 AS px, (1 + k % 10)::DOUBLE AS sz
          FROM base WHERE event_type IN ('purchase', 'error')""",
    ),
    "contexts": (
        ["base"],
        """SELECT symbol, ts_ms, event_id, CASE WHEN k < 50 THEN 'open' ELSE 'halted' END AS status, value / 10 AS oracle_gap
          FROM base WHERE event_type = 'signup'""",
    ),
    "fundings": (
        ["base"],
        """SELECT run_id, symbol, ts_ms, event_id AS funding_id, (k - 50) / 1000.0::DOUBLE AS amount
          FROM base WHERE event_type = 'signup'""",
    ),
    "deals": (["trades"], "SELECT *, sz * 0.015::DOUBLE AS fee FROM trades"),
    "ledger": (
        ["base"],
        f"""SELECT variant AS run_id, ts_ms AS block_ts_ms, event_id AS book_event_id, (k - 50) / 10.0::DOUBLE * (1 + n) AS position,
          CASE WHEN k <> 7 THEN value - 50 + n * (k - 49) END AS total_pnl, value * 0.5::DOUBLE + n AS price_pnl,
          k * 0.25::DOUBLE - n AS unrealized_pnl, -value * 0.01::DOUBLE AS fees, k * 0.001::DOUBLE AS rebates, (k - 50) / 1000.0::DOUBLE AS funding,
          CASE WHEN k <> 3 THEN px0 END AS mark_price, 1.0::DOUBLE + event_id % 13 + k / 100.0::DOUBLE AS market_spread_bps,
          (k - 50)::DOUBLE AS signed_volume, abs((value - 50) / 1e4) AS abs_mid_ret, k + n < 6 AS halt_triggered,
          k - n > 90 AS pull_triggered, k + n = 50 AS stop_triggered, k + n BETWEEN 10 AND 20 AS boost_triggered,
          k + n BETWEEN 20 AND 35 AS post_pull_unwind_active FROM base, {_VARIANTS}""",
    ),
    "run_fills": (
        ["base"],
        f"""SELECT variant AS run_id, event_id AS order_id, ts_ms AS block_ts_ms, event_id AS book_event_id,
          CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side, round(px0 + n * 0.01::DOUBLE, 4) AS price,
          (1 + k % 10)::DOUBLE AS size FROM base, {_VARIANTS} WHERE event_type IN ('purchase', 'error')""",
    ),
    "log_market": (
        ["base"],
        """SELECT run_id, ts_ms, event_id AS seq, CASE WHEN k >= 5 THEN round(px0 - 0.01::DOUBLE * (1 + event_id % 5), 4) END AS best_bid,
          CASE WHEN k >= 5 THEN round(px0 + 0.01::DOUBLE * (1 + event_id % 7), 4) END AS best_ask, CASE WHEN k IN (3, 4) THEN px0 END AS mid,
          CASE WHEN k > 0 THEN px0 END AS mark_px, CASE WHEN k <> 9 THEN k % 5 = 0 END AS spread_filter_active,
          k < 6 AS boost_active, k = 99 AS reconnect, k % 2 = 0 AS top_px_change FROM base""",
    ),
    "log_decisions": (
        ["base"],
        """SELECT run_id, ts_ms, event_id AS seq, k >= 90 AS boost_active, CASE WHEN k % 4 <> 0 THEN 1 + k / 10.0::DOUBLE END AS raw_bid_sz,
          CASE WHEN k % 4 <> 0 THEN k / 10.0::DOUBLE END AS raw_ask_sz, k % 8 = 0 AS halt_triggered, k % 12 = 0 AS stop_triggered,
          k % 5 = 0 AS spread_filter_active, CASE WHEN k > 1 THEN round(px0 - 0.01::DOUBLE * (1 + event_id % 3), 4) END AS final_bid_px,
          CASE WHEN k > 1 THEN round(px0 + 0.01::DOUBLE * (1 + event_id % 3), 4) END AS final_ask_px, 1.0::DOUBLE AS base_size,
          1 + k / 100.0::DOUBLE AS final_bid_sz, 0.9::DOUBLE + k / 90.0::DOUBLE AS final_ask_sz, k = 13 AS crossed FROM base""",
    ),
    "log_orders": (
        ["base"],
        f"""SELECT run_id, ts_ms, event_id AS seq, {_sql_pick(ACTIONS, 'event_id')} AS action, ' c' || user_id AS client_oid,
          {_LOG_SIDE} AS side, CASE WHEN k % 2 = 0 THEN {_sql_pick(ERROR_TEXTS, 'k // 2')} END AS error,
          CASE WHEN k % 7 = 0 THEN 'reconnect' WHEN event_id % 4 = 2 THEN 'risk_escape_cancel_and_skip'
          WHEN event_id % 4 = 3 THEN 'risk_escape_cancel_and_skip_fallback' END AS reason,
          CASE WHEN k % 5 = 0 THEN 'error' ELSE 'ok' END AS status, round(1 + k / 16.0::DOUBLE, 4) AS effective_spread_bps,
          k % 4 = 1 AS reject_backoff_active, k % 6 = 0 AS risk_escape_triggered, k % 6 = 0 AS risk_escape_applied,
          CASE WHEN k < 80 THEN 'b' || (k % 3) END AS risk_escape_bucket, CASE WHEN k < 60 THEN 'Widen' ELSE 'skip' END AS risk_escape_mode,
          k % 9 = 0 AS risk_size_down_applied, k % 11 = 0 AS risk_escape_global_lag_quiet_trigger,
          (k % 4)::DOUBLE AS risk_escape_delta_ticks, value - 5 AS send_latency_ms, value * 2 AS pre_send_book_age_ms,
          CASE WHEN k <> 11 THEN value * 3 - 10 END AS pre_send_recv_age_ms, k % 10 = 2 AS pre_send_marketable,
          CASE WHEN k % 7 <> 1 THEN (k % 4) * 0.6::DOUBLE END AS pre_send_spread_ticks,
          CASE WHEN k % 5 <> 0 THEN 'm' || (k % 2) END AS pre_send_round_mode, event_id // 3 AS batch_id FROM base""",
    ),
    "log_fills": (
        ["base"],
        """SELECT run_id, ts_ms + (k - 50) * 1000 AS time, event_id AS seq,
          CASE WHEN k = 44 THEN '?' WHEN event_type = 'purchase' THEN 'B' ELSE 'A' END AS side, CASE WHEN k <> 17 THEN px0 END AS px,
          (k % 10)::DOUBLE AS sz, CASE WHEN k <> 21 THEN (k % 10) * 0.015::DOUBLE END AS fee, k % 25 = 4 AS crossed,
          CASE WHEN k % 8 <> 0 THEN 'c' || user_id END AS cloid FROM base WHERE event_type IN ('purchase', 'error')""",
    ),
    "log_events": (
        ["base"],
        f"""SELECT run_id, ts_ms, event_id AS seq, {_NAME} AS event,
          CASE WHEN {_NAME} = 'replace_guard' THEN (CASE WHEN k % 2 = 0 THEN 'replace->skip (' ELSE 'replace->new (' END)
            || {_sql_pick(GUARD_REASONS, 'k')} || ')'
          WHEN {_NAME} = 'send_skip' AND k % 3 = 0 THEN 'pre_send_stale_book'
          WHEN {_NAME} = 'send_skip' AND k % 3 = 1 THEN 'pre_send_guard_all_skipped'
          WHEN {_NAME} IN ('open_orders_sync', 'open_orders_error') AND k < 50 THEN 'periodic'
          WHEN k % 3 = 0 THEN 'other' END AS reason,
          COALESCE({_LOG_SIDE}, '-') AS side_key, CASE WHEN k < 80 THEN 'b' || (k % 3) ELSE 'none' END AS bucket,
          CASE WHEN {_NAME} = 'risk_escape_cancel_all_fallback' THEN (CASE WHEN k % 2 = 0 THEN 'cooldown_skip' ELSE 'sent' END)
          WHEN k % 3 = 0 THEN 'skip_only' WHEN k % 3 = 1 THEN 'cancel_enqueued' END AS decision, k % 4 <> 0 AS cancel_needed,
          CASE WHEN k % 6 = 0 THEN 'no_order_on_side' WHEN k % 6 = 3 THEN 'resync_failed' END AS skip_reason,
          CASE WHEN k <> 31 THEN k * 10.0::DOUBLE - 20 END AS cooldown_ms, CASE WHEN k % 10 <> 9 THEN k % 3 <> 0 END AS open_bid_present,
          CASE WHEN k % 10 <> 8 THEN k % 4 <> 0 END AS open_ask_present,
          CASE WHEN k % 5 = 0 THEN ts_ms - k * 100 END AS last_open_orders_sync_ts, value - 3 AS pre_send_recv_age_ms FROM base""",
    ),
}


def with_ctes(needs: str, sql: str) -> str:
    """Prefix ``sql`` with the named CTEs (space separated) and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
