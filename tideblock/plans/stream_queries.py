"""The streaming operators run over the whole given table, as streams that stop when all has been read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.plans import views as v
from tideblock.plans.catalog import query
from tideblock.plans.market_queries import _WIRE, _WIRE_NEEDS, blocks, raw_files
from tideblock.streaming import market as sm
from tideblock.streaming import sinks as ss
from tideblock.streaming import state as st

HOUR = v.HOUR_MS
DELAY = "10 minutes"


def as_stream(df: DataFrame, label: str) -> DataFrame:
    """The rows of a batch frame as a file stream."""
    spark = df.sparkSession
    path = scratch.new_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return v.trades(spark, sf).drop("ts")


@query("i1_stream_ingest", _WIRE_NEEDS, f"WITH {_WIRE} SELECT kind AS event_type, count(*) AS n FROM wire WHERE ok GROUP BY ALL")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    typed = sm.ingest(sm.read_raw_stream(spark, raw_files(spark, sf), 4, "*.txt*")).select("event_type", "symbol", "dedupe_key")
    return ss.collect_stream(typed).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def again(rows: DataFrame, after_ms: int) -> DataFrame:
    """Every row twice: the second arrives ``after_ms`` later (``arrival``), often in another micro-batch."""
    return rows.withColumn("arrival", F.explode(F.array(F.col("ts_ms"), F.col("ts_ms") + after_ms)))


@query("i2_stream_dedupe_trades", "trades", "SELECT symbol, trade_id, px, sz FROM trades", "px sz")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    handler = sm.dedupe_trades(spark, scratch.new_path(spark, "dedupe"), 24 * HOUR)
    ss.replay_into(again(trades(spark, sf), 12 * HOUR), "arrival", handler.handle)
    return handler.emitted("rows").select("symbol", "trade_id", "px", "sz")


_START = 1_704_500_000_000


@query("i3_stream_dedupe_fills", "log_fills", f"SELECT run_id, CAST(seq AS VARCHAR) AS fill_id, px FROM log_fills WHERE cloid IS NOT NULL AND time >= {_START}", "px")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.log_fills(spark, sf).withColumns(
        {"ts_ms": F.col("time").cast("bigint"), "tid": F.lit(None).cast("string"), "hash": F.when(F.col("cloid").isNotNull(), F.col("seq").cast("string"))}
    )
    handler = sm.dedupe_fills(spark, scratch.new_path(spark, "dedupe"), 24 * HOUR, ["ts_ms", "seq"])
    ss.replay_into(sm.with_fill_id(again(rows, 12 * HOUR), _START), "arrival", handler.handle)
    return handler.emitted("rows").select("run_id", "fill_id", "px")


@query("i4_stream_ohlcv", "trades", """SELECT * FROM (SELECT symbol, ts_ms // 3600000 * 3600000 AS t, arg_min(px, (ts_ms, event_id)) AS o, max(px) AS h, min(px) AS l, arg_max(px, (ts_ms, event_id)) AS c, sum(sz) AS v, count(*) AS n FROM trades GROUP BY ALL)""", "o h l c v")
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return ss.replay(trades(spark, sf), "ts_ms", lambda stream: sm.ohlcv(stream, "1 hour", DELAY), 24 * HOUR)


@query("i5_stream_sliding_flow", "trades", """SELECT symbol, s AS start_ms, s + 7200000 AS end_ms, sum(CASE WHEN side = 'buy' THEN sz ELSE -sz END) AS signed_volume FROM
  (SELECT *, ts_ms // 3600000 * 3600000 - o AS s FROM trades, (VALUES (0), (3600000)) t(o)) GROUP BY ALL""", "signed_volume")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return ss.replay(trades(spark, sf), "ts_ms", lambda stream: sm.sliding_flow(stream, "2 hours", "1 hour", DELAY), 24 * HOUR)


@query("i6_stream_block_state", "state", """SELECT symbol, block_ts_ms, book_event_id, mid, CASE WHEN block_ts_ms - prev_ts < 7200000 THEN mid_ret END AS mid_ret, COALESCE(block_ts_ms - prev_ts >= 7200000, false) AS reconnect,
  prev_id IS NOT NULL AND (bid_px IS DISTINCT FROM prev_bid OR ask_px IS DISTINCT FROM prev_ask) AS top_px_change,
  prev_id IS NOT NULL AND (bid_px IS DISTINCT FROM prev_bid OR ask_px IS DISTINCT FROM prev_ask OR bid_sz IS DISTINCT FROM prev_bid_sz OR ask_sz IS DISTINCT FROM prev_ask_sz) AS book_change, signed_volume_window FROM
  (SELECT *, sum(signed_volume_lenient) OVER (PARTITION BY symbol ORDER BY block_ts_ms, book_event_id ROWS UNBOUNDED PRECEDING) - COALESCE((SELECT sum(p.signed_volume_lenient) FROM state p WHERE p.symbol = b.symbol AND p.block_ts_ms < b.block_ts_ms - 21600000), 0) AS signed_volume_window,
   lag(bid_sz) OVER w AS prev_bid_sz, lag(ask_sz) OVER w AS prev_ask_sz FROM state b WINDOW w AS (PARTITION BY symbol ORDER BY block_ts_ms, book_event_id))""", "mid mid_ret signed_volume_window")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    handler = st.BlockState(spark, scratch.new_path(spark, "block_state"), 2 * HOUR, 6 * HOUR)
    ss.replay_into(scratch.keep(blocks(spark, sf), "blocks"), "block_ts_ms", handler.handle)
    return handler.emitted("rows")


@query("i7_stream_session_gaps", "trades", """SELECT symbol, start_ms, last_ms, n FROM (SELECT symbol, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) AS g FROM
  (SELECT *, COALESCE((ts_ms - lag(ts_ms) OVER (PARTITION BY symbol ORDER BY ts_ms, event_id) >= 7200000)::INT, 1) AS s FROM trades)) GROUP BY symbol, g)""")
def i7(spark: SparkSession, sf: str) -> DataFrame:
    return ss.replay(trades(spark, sf), "ts_ms", lambda stream: sm.session_gaps(stream, 2 * HOUR, DELAY), 24 * HOUR)


@query("i8_stream_fill_gate", "log_fills", "SELECT run_id, count(*) AS fills, sum(px * sz) AS notional, count(*) >= 170 AND sum(px * sz) >= 80000 AS reached FROM log_fills WHERE px IS NOT NULL AND sz > 0 GROUP BY ALL", "notional")
def i8(spark: SparkSession, sf: str) -> DataFrame:
    return ss.last_complete(sm.fill_gate(as_stream(v.log_fills(spark, sf), "fills"), 170, 80_000.0))


@query("i9_stream_run_monitor", "base", """WITH r AS (SELECT run_id, count(*) AS fills_count, sum(value) AS notional_sum, count(*) FILTER (k > 5) AS fills_joined_count, avg(k) - 49.5::DOUBLE AS net_med, avg(value) - 52 AS net_p10, 45 - avg(value) AS markout30_med, max(ts_ms) AS mtime FROM base GROUP BY ALL),
  g AS (SELECT *, row_number() OVER (ORDER BY mtime DESC, run_id DESC) AS rn, markout30_med < -5 AS warn FROM r WHERE fills_count >= 10 AND notional_sum >= 300 AND fills_joined_count > 0 QUALIFY rn <= 10),
  p AS (SELECT *, warn AND COALESCE(lag(warn) OVER (ORDER BY rn), false) AS again FROM g)
  SELECT count(*) AS runs, median(net_med) AS net_med_median, avg((net_med > 0)::INT) AS net_med_win_rate, min(net_p10) AS net_p10_min, count(*) FILTER (warn) AS warn_count, bool_or(again) AS warn_consecutive FROM p""", "net_med_median net_med_win_rate net_p10_min")
def i9(spark: SparkSession, sf: str) -> DataFrame:
    k, value = F.col("k"), F.col("value")
    reports = v.base(spark, sf).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fills_count"), F.sum(value).alias("notional_sum"), F.count_if(k > 5).alias("fills_joined_count"), (F.avg(k) - 49.5).alias("net_med"),
        (F.avg(value) - 52).alias("net_p10"), (45 - F.avg(value)).alias("markout30_med"), F.max("ts_ms").alias("mtime"),
        F.lit(False).alias("taker_guard_trip"), F.lit(0.0).alias("taker_notional_share"),
    )
    monitor = st.RunMonitor(spark, scratch.new_path(spark, "monitor"))
    ss.replay_into(reports, "mtime", monitor.handle)
    return monitor.rollup().select("runs", "net_med_median", "net_med_win_rate", "net_p10_min", "warn_count", "warn_consecutive")


@query("i10_stream_fill_markout", "trades books", """SELECT symbol, fill_id, side, CASE WHEN side = 'buy' THEN m - px ELSE px - m END AS markout FROM
  (SELECT f.symbol, f.event_id AS fill_id, f.side, f.px, arg_min((b.bid_px + b.ask_px) / 2, (b.ts_ms, b.event_id)) AS m FROM trades f LEFT JOIN books b ON b.symbol = f.symbol AND b.bid_px IS NOT NULL AND b.ask_px IS NOT NULL
   AND b.ts_ms BETWEEN f.ts_ms + 3600000 AND f.ts_ms + 3600000 + 7200000 GROUP BY ALL)""", "markout")
def i10(spark: SparkSession, sf: str) -> DataFrame:
    fills = trades(spark, sf).withColumnRenamed("event_id", "fill_id")
    mids = v.books(spark, sf).select("symbol", "ts_ms", "event_id", ((F.col("bid_px") + F.col("ask_px")) / 2).alias("mid"))
    handler = st.FillMarkout(spark, scratch.new_path(spark, "markout"), HOUR, 2 * HOUR, HOUR // 6)
    ss.replay_into(scratch.keep(st.markout_input(fills, mids), "markout"), "ts_ms", handler.handle, 24 * HOUR)
    return handler.emitted("rows")
