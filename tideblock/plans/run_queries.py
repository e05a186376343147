"""Queries over run ledgers and fills: metrics, window splits, comparisons, A/B, quoting and order evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import book as bk
from tideblock.functions import quoting as qt
from tideblock.operators import blocks as bl
from tideblock.operators import orderfills as of
from tideblock.operators import positions as ps
from tideblock.operators import runs as rn
from tideblock.plans import views as v
from tideblock.plans.catalog import query
from tideblock.sources import logs, sinks

DAY = 24 * v.HOUR_MS
WINDOW, STEP = 4 * DAY, DAY

_INC = ", ".join(
    f"{c} - COALESCE(lag({c} IGNORE NULLS) OVER w, 0) AS d_{c}" for c in rn.DELTA_COLUMNS
)
v.CTES.update(
    {
        "led_w": (
            ["ledger"],
            """SELECT l.*, l.book_event_id IN (SELECT book_event_id FROM ledger WHERE run_id = 'base' AND halt_triggered) AS in_window,
            lag(position) OVER w AS prev_pos, lag(mark_price) OVER w AS prev_mark, row_number() OVER w AS rn,
            total_pnl - COALESCE(lag(total_pnl) OVER w, 0) AS pnl_delta,
            max(total_pnl) OVER (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id ROWS UNBOUNDED PRECEDING) AS peak
            FROM ledger l WINDOW w AS (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id)""",
        ),
        "fills_w": (
            ["ledger", "run_fills"],
            """SELECT f.*, f.book_event_id IN (SELECT book_event_id FROM ledger WHERE run_id = 'base' AND halt_triggered) AS in_window FROM run_fills f""",
        ),
        "outcomes": (
            ["ledger", "fills_w"],
            """SELECT f.run_id, f.book_event_id, f.side, f.price, f.size, f.in_window, f.horizon_ms, CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (u.m - n.m) AS markout,
            CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (u.m - f.price) AS realized_spread FROM
            (SELECT g.*, h AS horizon_ms, block_ts_ms + h AS due FROM fills_w g, (VALUES (3600000), (14400000)) t(h)) f
            ASOF LEFT JOIN (SELECT run_id, block_ts_ms AS ts, arg_max(mark_price, book_event_id) AS m FROM ledger WHERE mark_price IS NOT NULL GROUP BY ALL) n
              ON f.run_id = n.run_id AND f.block_ts_ms >= n.ts
            ASOF LEFT JOIN (SELECT run_id, block_ts_ms AS ts, arg_min(mark_price, book_event_id) AS m FROM ledger WHERE mark_price IS NOT NULL GROUP BY ALL) u
              ON f.run_id = u.run_id AND f.due <= u.ts""",
        ),
        "positions": (
            ["deals", "fundings"],
            """SELECT *, (last_px - avg_cost) * position AS unreal FROM (
            SELECT *, CASE WHEN position <> 0 THEN seg_cost / position END AS avg_cost, sum(gain) OVER w AS price_pnl FROM (
            SELECT *, CASE WHEN starts AND before <> 0 THEN least(abs(before), abs(s)) * (px - lag_cost / before) * sign(before) ELSE 0 END AS gain FROM (
            SELECT *, lag(seg_cost) OVER (PARTITION BY run_id ORDER BY ts_ms, kind, id) AS lag_cost FROM (
            SELECT *, sum(cost) OVER (PARTITION BY run_id, seg ORDER BY ts_ms, kind, id) AS seg_cost FROM (
            SELECT *, sum(starts::INT) OVER w AS seg, CASE WHEN starts THEN position * px ELSE s * COALESCE(px, 0) END AS cost FROM (
            SELECT *, position - s AS before, kind = 1 AND NOT (position - s <> 0 AND sign(position - s) = sign(s)) AS starts FROM (
            SELECT *, sum(s) OVER w AS position, -sum(fee) OVER w AS fees, sum(amount) OVER w AS funding, last_value(px IGNORE NULLS) OVER w AS last_px,
              max(CASE WHEN kind = 1 THEN ts_ms END) OVER (PARTITION BY run_id) AS last_fill FROM (
            SELECT run_id, ts_ms, 1 AS kind, trade_id AS id, trade_id, side, px, sz, CASE WHEN side = 'buy' THEN sz ELSE -sz END AS s, fee, 0 AS amount FROM deals
            UNION ALL SELECT run_id, ts_ms, 0, CAST(funding_id AS VARCHAR), NULL, NULL, NULL, NULL, 0, 0, amount FROM fundings)
            WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms, kind, id)))
            WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms, kind, id)))))
            WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms, kind, id)) WHERE kind = 1 OR ts_ms > COALESCE(last_fill, 0)""",
        ),
        "win_led": (
            ["ledger"],
            f"""SELECT l.*, i AS window_no, strftime(make_timestamp((s + i * {STEP}) * 1000), '%Y%m%d_%H%M') AS window_id, s + i * {STEP} AS start_ms FROM ledger l,
            (SELECT s, e, unnest(range(0, greatest((e - s - {WINDOW}) // {STEP} + 1, 0))) AS i FROM (SELECT min(block_ts_ms) AS s, max(block_ts_ms) AS e FROM ledger))
            WHERE s + i * {STEP} + {WINDOW} <= e AND block_ts_ms >= s + i * {STEP} AND block_ts_ms < s + i * {STEP} + {WINDOW}""",
        ),
        "ab_results": (
            ["win_led"],
            """SELECT run_id AS variant, window_id, arg_max(total_pnl, (block_ts_ms, book_event_id)) AS pnl, avg(position) AS inventory, count(*) AS blocks,
            avg(halt_triggered::INT) AS halt_rate FROM win_led WHERE total_pnl IS NOT NULL GROUP BY ALL""",
        ),
        "ab_pairs": (
            ["ab_results"],
            """SELECT c.*, b.pnl AS base_pnl, c.pnl - b.pnl AS delta_pnl, c.inventory - b.inventory AS delta_inventory FROM ab_results c JOIN ab_results b
            ON b.variant = 'base' AND b.window_id = c.window_id WHERE c.variant <> 'base'""",
        ),
    }
)


def base_run() -> Column:
    return F.col("run_id") == "base"


def window(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks in which the base run halted."""
    return rn.window_keys(v.ledger(spark, sf), F.col("halt_triggered"), run=base_run())


# ---- run metrics ----


@query("d4_run_basics", "ledger run_fills", """SELECT run_id, num_blocks, num_fills, notional_traded, least(1, num_fills / (2 * num_blocks)) AS fill_rate, pnl FROM
  (SELECT run_id, count(*) AS num_blocks, arg_max_null(total_pnl, (block_ts_ms, book_event_id)) AS pnl FROM ledger GROUP BY ALL) JOIN
  (SELECT run_id, count(*) AS num_fills, sum(abs(price) * abs(size)) AS notional_traded FROM run_fills GROUP BY ALL) USING (run_id)""", "notional_traded fill_rate pnl")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return rn.run_basics(v.ledger(spark, sf), v.run_fills(spark, sf))


@query("d5_inventory_stats", "ledger", """SELECT run_id, avg(position) AS mean, max(abs(position)) AS max_abs, quantile_cont(position, 0.1) AS p10, quantile_cont(position, 0.9) AS p90,
  quantile_cont(position, 0.95) AS p95 FROM ledger GROUP BY ALL""", "mean max_abs p10 p90 p95")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    return rn.inventory_stats(v.ledger(spark, sf))


@query("d6_fee_breakdown", "ledger", """SELECT run_id, arg_max(fees, (block_ts_ms, book_event_id)) AS fees, arg_max(rebates, (block_ts_ms, book_event_id)) AS rebates,
  arg_max(funding, (block_ts_ms, book_event_id)) AS funding FROM ledger GROUP BY ALL""", "fees rebates funding")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return rn.fee_breakdown(v.ledger(spark, sf))


_FLAG_SQL = ", ".join([f"count(*) FILTER ({c}) AS {c}_count, avg({c}::INT) AS {c}_rate" for c in rn.FLAGS])


@query("d7_trigger_counts", "ledger", f"SELECT run_id, {_FLAG_SQL} FROM ledger GROUP BY ALL", " ".join(f"{c}_rate" for c in rn.FLAGS))
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return rn.trigger_counts(v.ledger(spark, sf))


_WHEN = ", ".join(f"COALESCE(sum(pnl_delta) FILTER ({c}), 0) AS pnl_in_{c}, COALESCE(sum(pnl_delta) FILTER (NOT {c}), 0) AS pnl_out_{c}" for c in rn.FLAGS)


@query("d8_pnl_when", "led_w", f"SELECT run_id, {_WHEN} FROM led_w GROUP BY ALL", " ".join(f"pnl_in_{c} pnl_out_{c}" for c in rn.FLAGS))
def d8(spark: SparkSession, sf: str) -> DataFrame:
    return rn.pnl_when(v.ledger(spark, sf))


@query("d9_window_split_pnl", "led_w", f"SELECT run_id, in_window, {', '.join(f'COALESCE(sum(d_{c}), 0) AS {c}' for c in rn.DELTA_COLUMNS)} FROM (SELECT *, {_INC} FROM led_w WINDOW w AS (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id)) GROUP BY ALL",
       " ".join(rn.DELTA_COLUMNS))
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_pnl(v.ledger(spark, sf), window(spark, sf))


@query("d10_window_split_fills", "fills_w", "SELECT run_id, in_window, count(*) AS fills, sum(price * size) AS notional FROM fills_w GROUP BY ALL", "notional")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_fills(v.run_fills(spark, sf), window(spark, sf))


@query("d11_window_split_inventory", "led_w", "SELECT run_id, in_window, avg(position) AS mean, max(abs(position)) AS max_abs, quantile_cont(position, 0.95) AS p95 FROM led_w GROUP BY ALL", "mean max_abs p95")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_inventory(v.ledger(spark, sf), window(spark, sf))


@query("d12_window_split_exposure", "led_w", """SELECT run_id, in_window, sum(pp * d) AS pos_ret, avg(pp) AS mean_pos_prev, avg(d) AS mean_dprice, corr(pp, d) AS corr_pos_prev_dprice
  FROM (SELECT *, COALESCE(prev_pos, 0) AS pp, mark_price - prev_mark AS d FROM led_w WHERE rn > 1) WHERE d IS NOT NULL GROUP BY ALL""", "pos_ret mean_pos_prev mean_dprice corr_pos_prev_dprice")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_exposure(v.ledger(spark, sf), window(spark, sf))


@query("d13_window_split_flag_rate", "led_w", "SELECT run_id, in_window, count(*) FILTER (pull_triggered) AS n_true, count(*) AS n, avg(pull_triggered::INT) AS rate FROM led_w GROUP BY ALL", "rate")
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_flag(v.ledger(spark, sf), window(spark, sf), "pull_triggered")


@query("d14_window_split_markout", "outcomes", "SELECT run_id, in_window, avg(markout) AS markout, avg(realized_spread) AS realized_spread FROM outcomes WHERE horizon_ms = 14400000 AND markout IS NOT NULL GROUP BY ALL", "markout realized_spread")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return rn.split_markout(v.ledger(spark, sf), v.run_fills(spark, sf), window(spark, sf), 4 * v.HOUR_MS)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return rn.fill_outcomes(v.run_fills(spark, sf), rn.mid_series(v.ledger(spark, sf), "mark_price"), [v.HOUR_MS, 4 * v.HOUR_MS])


@query("c5_c6_realized_spread_markout", "outcomes", "SELECT run_id, horizon_ms, avg(markout) AS markout, avg(realized_spread) AS realized_spread, count(markout) AS n FROM outcomes GROUP BY ALL", "markout realized_spread", "horizon_ms")
def c5(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).groupBy("run_id", "horizon_ms").agg(
        F.avg("markout").alias("markout"), F.avg("realized_spread").alias("realized_spread"), F.count("markout").alias("n")
    )


@query("c7_c8_fills_notional_when", "ledger run_fills", """SELECT run_id, count(*) AS fills, sum(price * size) AS notional FROM run_fills f WHERE EXISTS
  (SELECT 1 FROM ledger l WHERE l.run_id = f.run_id AND l.book_event_id = f.book_event_id AND pull_triggered) GROUP BY ALL""", "notional")
def c7(spark: SparkSession, sf: str) -> DataFrame:
    return rn.fills_when(v.ledger(spark, sf), v.run_fills(spark, sf), "pull_triggered")


@query("c10_g2_window_membership", "led_w", "SELECT run_id, in_window, count(*) AS n FROM led_w GROUP BY ALL")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return rn.mark_window(v.ledger(spark, sf), window(spark, sf)).groupBy("run_id", "in_window").agg(F.count(F.lit(1)).alias("n"))


@query("c11_trigger_or_threshold_window", "ledger", """SELECT run_id, count(*) FILTER (abs_mid_ret > 0.004) AS by_threshold, count(*) FILTER (boost_triggered) AS by_flag FROM ledger GROUP BY ALL""")
def c11(spark: SparkSession, sf: str) -> DataFrame:
    led = v.ledger(spark, sf)
    without = led.drop("boost_triggered")
    by_flag = led.groupBy("run_id").agg(F.count_if(rn.flag_or_threshold(led, "boost_triggered", 0.004)).alias("by_flag"))
    by_thr = without.groupBy("run_id").agg(F.count_if(rn.flag_or_threshold(without, "boost_triggered", 0.004)).alias("by_threshold"))
    return by_flag.join(by_thr, "run_id")


@query("c12_d22_flow_markout", "ledger outcomes", """WITH cut AS (SELECT run_id, quantile_cont(abs(signed_volume), 0.9) AS threshold FROM ledger GROUP BY ALL),
  g AS (SELECT o.*, threshold, CASE WHEN o.side = 'buy' THEN 'bid' ELSE 'ask' END AS quote_side, CASE WHEN signed_volume > threshold THEN 'pos' WHEN signed_volume < -threshold THEN 'neg' END AS flow
   FROM outcomes o JOIN ledger USING (run_id, book_event_id) JOIN cut USING (run_id) WHERE horizon_ms = 14400000 AND markout IS NOT NULL)
  SELECT run_id, quote_side, flow, count(*) AS n, avg(markout) AS mean, sum(price * size) AS notional, sum(markout * price * size) AS markout_notional, max(threshold) AS threshold,
  sum(markout * price * size) / sum(price * size) AS weighted_mean, quantile_cont(markout, 0.1) AS p10, quantile_cont(markout, 0.5) AS p50, quantile_cont(markout, 0.9) AS p90
  FROM g WHERE flow IS NOT NULL GROUP BY ALL""", "mean notional markout_notional threshold weighted_mean p10 p50 p90")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    led = v.ledger(spark, sf)
    late = rn.fill_outcomes(v.run_fills(spark, sf), rn.mid_series(led, "mark_price"), [4 * v.HOUR_MS])
    return rn.flow_markout(late, led, "signed_volume", 0.9)


@query("c21_unwind_outside_window", "ledger run_fills", """WITH a AS (SELECT * FROM ledger WHERE post_pull_unwind_active AND book_event_id NOT IN (SELECT book_event_id FROM ledger WHERE run_id = 'base' AND pull_triggered))
  SELECT r.run_id, avg_abs_pos, COALESCE(fills, 0) AS fills, COALESCE(notional, 0) AS notional FROM (SELECT run_id, avg(abs(position)) AS avg_abs_pos FROM a GROUP BY ALL) r LEFT JOIN
  (SELECT f.run_id, count(*) AS fills, sum(price * size) AS notional FROM run_fills f JOIN a USING (run_id, book_event_id) GROUP BY ALL) USING (run_id)""", "avg_abs_pos notional")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    led = v.ledger(spark, sf)
    return rn.unwind_outside_window(led, v.run_fills(spark, sf), rn.window_keys(led, F.col("pull_triggered"), run=base_run()))


@query("e5_pnl_delta", "ledger", f"SELECT run_id, book_event_id, total_pnl - COALESCE(lag(total_pnl) OVER w, 0) AS delta_total_pnl, price_pnl - COALESCE(lag(price_pnl) OVER w, 0) AS delta_price_pnl FROM ledger WINDOW w AS (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id)", "delta_total_pnl delta_price_pnl")
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return rn.increments(v.ledger(spark, sf).select("run_id", *bl.BLOCK, "total_pnl", "price_pnl"), ["total_pnl", "price_pnl"]).select("run_id", "book_event_id", "delta_total_pnl", "delta_price_pnl")


@query("e6_drawdown", "led_w", "SELECT run_id, min(total_pnl - peak) AS max_drawdown, min(total_pnl - greatest(peak, 0)) AS max_drawdown_from_zero FROM led_w GROUP BY ALL", "max_drawdown max_drawdown_from_zero")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    rows = rn.drawdown(v.ledger(spark, sf).select("run_id", *bl.BLOCK, "total_pnl"))
    peak = F.col("total_pnl") - F.col("drawdown")
    zero = F.min(F.col("total_pnl") - F.greatest(peak, F.lit(0.0)))
    return rows.groupBy("run_id").agg(F.min("drawdown").alias("max_drawdown"), zero.alias("max_drawdown_from_zero"))


_POS = "position avg_cost price_pnl fees funding unrealized_pnl total_pnl"


@query("e8_c17_position_ledger", "positions", """SELECT run_id, ts_ms, trade_id, position, avg_cost, price_pnl, fees, funding, COALESCE(unreal, 0) AS unrealized_pnl,
  price_pnl + fees + funding + COALESCE(unreal, 0) AS total_pnl FROM positions""", _POS, digits=6)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    return ps.position_ledger(v.deals(spark, sf), v.fundings(spark, sf), ["run_id"]).select("run_id", "ts_ms", "trade_id", *_POS.split())


v.CTES["ledger_events"] = (
    ["deals", "fundings"],
    """SELECT *, row_number() OVER w AS rn, sum(s) OVER w AS position, -sum(fee) OVER w AS fees, sum(amount) OVER w AS funding, last_value(px IGNORE NULLS) OVER w AS last_px,
      max(CASE WHEN kind = 1 THEN ts_ms END) OVER (PARTITION BY run_id) AS last_fill FROM (
    SELECT run_id, ts_ms, 1 AS kind, trade_id AS id, trade_id, px, CASE WHEN side = 'buy' THEN sz ELSE -sz END AS s, fee, 0 AS amount FROM deals
    UNION ALL SELECT run_id, ts_ms, 0, CAST(funding_id AS VARCHAR), NULL, NULL, 0, 0, amount FROM fundings)
    WINDOW w AS (PARTITION BY run_id ORDER BY ts_ms, kind, id)""",
)
v.CTES["average_costs"] = (
    ["ledger_events"],
    """WITH RECURSIVE c AS (
    SELECT DISTINCT run_id, 0::BIGINT AS rn, 0::DOUBLE AS held, 0::DOUBLE AS cost, 0::DOUBLE AS pnl FROM ledger_events
    UNION ALL SELECT e.run_id, e.rn, e.position, CASE WHEN kind = 0 THEN cost WHEN held * s > 0 THEN cost + s * px WHEN held * e.position > 0 THEN cost * e.position / held ELSE e.position * px END,
      pnl + CASE WHEN kind = 1 AND held * s < 0 THEN least(abs(held), abs(s)) * sign(held) * (px - cost / held) ELSE 0 END
    FROM c JOIN ledger_events e ON e.run_id = c.run_id AND e.rn = c.rn + 1)
    SELECT run_id, rn, cost, pnl FROM c""",
)


@query("e8_average_cost_ledger", "ledger_events average_costs", """SELECT run_id, ts_ms, trade_id, position, avg_cost, pnl AS price_pnl, fees, funding, unreal AS unrealized_pnl, pnl + fees + funding + unreal AS total_pnl FROM (
  SELECT *, COALESCE((last_px - avg_cost) * position, 0) AS unreal FROM (SELECT e.*, pnl, CASE WHEN position <> 0 THEN cost / position END AS avg_cost FROM ledger_events e JOIN average_costs USING (run_id, rn))
  WHERE kind = 1 OR ts_ms > COALESCE(last_fill, 0))""", _POS, digits=6)  # costs of thousands, composed in another order than the recursion
def e8b(spark: SparkSession, sf: str) -> DataFrame:
    return ps.average_cost_ledger(v.deals(spark, sf), v.fundings(spark, sf), ["run_id"]).select("run_id", "ts_ms", "trade_id", *_POS.split())


@query("e17_overlapping_windows", "win_led", "SELECT window_no, window_id, start_ms, run_id, count(*) AS n FROM win_led GROUP BY ALL", "", "window_no")
def e17(spark: SparkSession, sf: str) -> DataFrame:
    rows = rn.assign_windows(v.ledger(spark, sf), WINDOW, STEP)
    return rows.groupBy("window_no", "window_id", "start_ms", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("e17_window_table", "win_led", f"SELECT DISTINCT window_no, start_ms, start_ms + {WINDOW} AS end_ms, window_id FROM win_led", "", "window_no")
def e17t(spark: SparkSession, sf: str) -> DataFrame:
    return rn.overlapping_windows(v.ledger(spark, sf), WINDOW, STEP)


# ---- comparison ----


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    led, fills = v.ledger(spark, sf), v.run_fills(spark, sf)
    return rn.run_basics(led, fills).join(rn.trigger_counts(led), "run_id")


_METRIC_SQL = """metrics AS (SELECT run_id, count(*)::DOUBLE AS num_blocks, arg_max_null(total_pnl, (block_ts_ms, book_event_id)) AS pnl, avg(halt_triggered::INT) AS halt_triggered_rate FROM ledger GROUP BY ALL),
  long AS (UNPIVOT metrics ON num_blocks, pnl, halt_triggered_rate INTO NAME metric VALUE value)"""
_METRICS = ["num_blocks", "pnl", "halt_triggered_rate"]


@query("c19_baseline_delta", "ledger", f"WITH {_METRIC_SQL} SELECT l.run_id, l.metric, l.value, l.value - b.value AS delta FROM long l JOIN long b ON b.metric = l.metric AND b.run_id = 'base'", "value delta")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    return rn.baseline_delta(rn.to_long(metrics(spark, sf), ["run_id"], _METRICS), "base")


@query("d48_f7_metric_table", "ledger", f"WITH {_METRIC_SQL} SELECT run_id, {', '.join(_METRICS)} FROM metrics ORDER BY run_id <> 'base', run_id", " ".join(_METRICS))
def d48(spark: SparkSession, sf: str) -> DataFrame:
    long = rn.to_long(metrics(spark, sf), ["run_id"], _METRICS)
    return rn.baseline_first(rn.metric_table(long, _METRICS), "base")


@query("a13_h15_scan_metrics_tree", "ledger", """SELECT run_id, avg(position) AS inventory_mean, max(abs(position)) AS inventory_max_abs, count(*) AS num_blocks FROM ledger GROUP BY ALL""", "inventory_mean inventory_max_abs")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "metrics")
    led = v.ledger(spark, sf)
    docs = led.groupBy("run_id").agg(
        F.struct(F.avg("position").alias("mean"), F.max(F.abs("position")).alias("max_abs")).alias("inventory"), F.count(F.lit(1)).alias("num_blocks")
    )
    docs.write.partitionBy("run_id").json(path)
    named = {"inventory_mean": "inventory.mean", "inventory_max_abs": "inventory.max_abs"}
    return logs.read_metrics(spark, path, "*.json").select("run_id", *[logs.metric_at(at).alias(n) for n, at in named.items()], "num_blocks")


@query("a15_tsv_table_sink", "ledger", "SELECT run_id, count(*) AS num_blocks FROM ledger GROUP BY ALL")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "tsv")
    sinks.write_tsv(v.ledger(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("num_blocks")), path)
    return spark.read.option("sep", "\t").option("header", "true").schema("run_id STRING, num_blocks BIGINT").csv(path)


_PRINT = """SELECT run_id, artifact, rows, sha256(rows || ':' || s || ':' || x) AS h FROM (SELECT run_id, artifact, count(*) AS rows, sum(b::HUGEINT)::VARCHAR AS s, bit_xor(b)::VARCHAR AS x FROM (
  SELECT run_id, artifact, CAST('0x' || substr(sha256(t), 1, 15) AS BIGINT) AS b FROM (SELECT run_id, a.artifact, CASE a.artifact WHEN 'orders' THEN concat_ws('|', order_id, block_ts_ms, side, size) ELSE concat_ws('|', order_id, block_ts_ms, side, price, size) END AS t
  FROM run_fills, (VALUES ('orders'), ('fills')) a(artifact))) GROUP BY ALL)"""


@query("a17_run_fingerprint", "run_fills", f"""WITH p AS ({_PRINT}) SELECT p.run_id, artifact, p.rows, substr(p.h, 1, 8) AS hash8, p.h = b.h AS same_as_baseline FROM p JOIN p b USING (artifact) WHERE b.run_id = 'base'""")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Two artifacts of a run: its orders are those of the baseline, its fills have prices of their own."""
    fills, key = v.run_fills(spark, sf), ["run_id", "artifact"]
    artifacts = {"orders": ["order_id", "block_ts_ms", "side", "size"], "fills": ["order_id", "block_ts_ms", "side", "price", "size"]}
    orders, deals = (rn.fingerprint(fills.withColumn("artifact", F.lit(name)), key, columns) for name, columns in artifacts.items())
    prints = orders.unionByName(deals)
    return rn.same_as_baseline(prints, "base").select("run_id", "artifact", "rows", "hash8", "same_as_baseline")


def ab_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = rn.assign_windows(v.ledger(spark, sf), WINDOW, STEP).filter(F.col("total_pnl").isNotNull())
    return rows.groupBy(F.col("run_id").alias("variant"), "window_id").agg(
        F.max_by("total_pnl", F.struct(*bl.BLOCK)).alias("pnl"), F.avg("position").alias("inventory"), F.count(F.lit(1)).alias("blocks"),
        F.avg(F.col("halt_triggered").cast("double")).alias("halt_rate"),
    )


@query("c20_ab_pairing", "ab_pairs", "SELECT variant, window_id, pnl, base_pnl, delta_pnl, delta_inventory FROM ab_pairs", "pnl base_pnl delta_pnl delta_inventory")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    pairs = rn.pair_windows(ab_results(spark, sf), "base", ["pnl", "inventory"])
    return pairs.select("variant", "window_id", "pnl", "base_pnl", "delta_pnl", "delta_inventory")


@query("d26_d27_ab_summary", "ab_pairs", """SELECT variant, windows, median_delta, wins, median_inventory, median_halt_rate, wins / windows AS win_rate,
  CASE WHEN median_delta > 0 AND wins / windows >= 0.55 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT variant, count(delta_pnl) AS windows, median(delta_pnl) AS median_delta,
  count(*) FILTER (delta_pnl > 0) AS wins, median(inventory) AS median_inventory, median(halt_rate) AS median_halt_rate FROM ab_pairs GROUP BY ALL)""", "median_delta median_inventory median_halt_rate win_rate")
def d26(spark: SparkSession, sf: str) -> DataFrame:
    return rn.ab_summary(rn.pair_windows(ab_results(spark, sf), "base", ["pnl"]), ["inventory", "halt_rate"])


@query("b32_mid_series", "ledger", "SELECT run_id, block_ts_ms AS mid_ts_ms, book_event_id AS mid_id, mark_price AS mid FROM ledger WHERE mark_price IS NOT NULL", "mid")
def b32(spark: SparkSession, sf: str) -> DataFrame:
    return rn.mid_series(v.ledger(spark, sf), "mark_price")


# ---- triggers, quotes and order evaluation ----

PARAMS = {
    "wide": dict(
        base_spread_bps=8.0, inventory_skew_bps=1.5, halt_when_market_spread_bps_gt=12.5, halt_size_factor=0.5, boost_when_abs_mid_ret_gt=0.004,
        boost_only_if_abs_pos_lt=4.0, boost_size_factor=1.5, boost_spread_add_bps=-2.0, stop_max_abs_position=4.8, stop_mode="unwind_only",
        pull_when_abs_signed_volume_gt=40.0, pull_mode="one_side", pull_spread_add_bps=3.0, pull_size_factor=0.4, max_abs_position=3.0,
    ),
    "flow": dict(
        stop_max_intraday_drawdown_usdc=-150.0, pull_when_market_spread_bps_lt=2.0, pull_spread_add_bps=1.0, pull_window_inventory_skew_mult=2.0,
        pull_window_max_abs_position=2.0, imbalance_thr=0.4, imbalance_size_factor=0.5, micro_bias_thr_bps=1.0, micro_bias_size_factor=0.25,
        ask_size_factor_when_sv_neg=0.5, pull_when_abs_signed_volume_gt=45.0, halt_when_abs_mid_ret_gt=0.02, base_size=2.0,
    ),
}


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Quoting states from the ledgers of all runs."""
    led = v.ledger(spark, sf).select("run_id", *bl.BLOCK, "total_pnl", "mark_price", "position", "market_spread_bps", "abs_mid_ret", "signed_volume")
    imb = F.col("signed_volume") / 100
    return rn.drawdown(led).select(
        "run_id", "book_event_id", "block_ts_ms", F.col("mark_price").alias("mid"), "position", "drawdown", "market_spread_bps", "abs_mid_ret", "signed_volume",
        F.lit(None).cast("double").alias("signed_volume_window"), imb.alias("imbalance"), (imb * 0.5).alias("micro_pos"), (imb * 4).alias("micro_bias_bps"),
        F.lit(False).alias("unwind_candidate"),
    )


v.CTES["states"] = (
    ["ledger"],
    """SELECT run_id, book_event_id, block_ts_ms, mark_price AS mid, COALESCE(position, 0) AS inv, market_spread_bps AS ms, abs_mid_ret AS amr, signed_volume AS sv, signed_volume / 100 AS imb, signed_volume / 100 * 4 AS mb,
    total_pnl - max(total_pnl) OVER (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id ROWS UNBOUNDED PRECEDING) AS dd FROM ledger""",
)


@query("b11_market_trigger_flags", "states", """SELECT run_id, book_event_id, 'wide' AS variant, ms > 12.5 AS halt_flag, amr > 0.004 AS boost_market_flag, false AS stop_market_flag, abs(sv) > 40 AS pull_flag FROM states
  UNION ALL SELECT run_id, book_event_id, 'flow', amr > 0.02, false, false, ms < 2.0 OR abs(sv) > 45 FROM states""")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    rows = qt.market_triggers(qt.with_variants(states(spark, sf), PARAMS))
    return rows.select("run_id", "book_event_id", "variant", "halt_flag", "boost_market_flag", "stop_market_flag", "pull_flag")


@query("b12_ledger_trigger_flags", "states", """SELECT run_id, book_event_id, 'wide' AS variant, amr > 0.004 AND abs(inv) < 4.0 AS boost_flag, abs(inv) >= 4.8 AS stop_flag FROM states
  UNION ALL SELECT run_id, book_event_id, 'flow', false, COALESCE(dd <= -150, false) FROM states""")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    rows = qt.with_variants(states(spark, sf), PARAMS).withColumn("inv", F.col("position") - F.col("p_inventory_target"))
    return qt.ledger_triggers(qt.market_triggers(rows)).select("run_id", "book_event_id", "variant", "boost_flag", "stop_flag")


@query("b13_pull_side", "states", "SELECT run_id, book_event_id, CASE WHEN sv > 0 THEN 'sell' WHEN sv < 0 THEN 'buy' END AS side FROM states")
def b13(spark: SparkSession, sf: str) -> DataFrame:
    rows = qt.with_variants(states(spark, sf), {"wide": PARAMS["wide"]})
    return rows.select("run_id", "book_event_id", qt.pull_side().alias("side"))


_Q = "bid_px ask_px bid_size ask_size"


@query("b14_quote_whatif", "states", """WITH f AS (SELECT *, COALESCE(ms > 12.5, false) AS halt_f, COALESCE(amr > 0.004 AND abs(inv) < 4.0, false) AS boost_f, abs(inv) >= 4.8 AS stop_f, abs(sv) > 40 AS pull_f FROM states),
  w AS (SELECT *, 8 + CASE WHEN pull_f AND sv < 0 THEN 3 ELSE 0 END - CASE WHEN boost_f THEN 2 ELSE 0 END AS bb, 8 + CASE WHEN pull_f AND sv > 0 THEN 3 ELSE 0 END - CASE WHEN boost_f THEN 2 ELSE 0 END AS ab,
    least(3, least(3, CASE WHEN pull_f AND sv < 0 THEN 0.4::DOUBLE ELSE 1 END) * CASE WHEN boost_f THEN 1.5::DOUBLE ELSE 1 END) * CASE WHEN halt_f THEN 0.5::DOUBLE ELSE 1 END AS bs,
    least(3, least(3, CASE WHEN pull_f AND sv > 0 THEN 0.4::DOUBLE ELSE 1 END) * CASE WHEN boost_f THEN 1.5::DOUBLE ELSE 1 END) * CASE WHEN halt_f THEN 0.5::DOUBLE ELSE 1 END AS az,
    mid * (1 - inv * 1.5::DOUBLE / 10000) AS c FROM f)
  SELECT run_id, book_event_id, 'wide' AS variant, CASE WHEN mid IS NULL THEN true ELSE stop_f AND inv = 0 END AS halt,
  CASE WHEN mid IS NULL THEN NULL WHEN stop_f THEN CASE WHEN inv < 0 THEN mid END ELSE c * (1 - bb / 10000) END AS bid_px,
  CASE WHEN mid IS NULL THEN NULL WHEN stop_f THEN CASE WHEN inv > 0 THEN mid END ELSE c * (1 + ab / 10000) END AS ask_px,
  CASE WHEN mid IS NULL THEN NULL WHEN stop_f THEN CASE WHEN inv < 0 THEN least(1, abs(inv)) END ELSE bs END AS bid_size,
  CASE WHEN mid IS NULL THEN NULL WHEN stop_f THEN CASE WHEN inv > 0 THEN least(1, abs(inv)) END ELSE az END AS ask_size FROM w
  UNION ALL SELECT run_id, book_event_id, 'flow', CASE WHEN mid IS NULL OR stop2 THEN true ELSE h2 END, CASE WHEN NOT stop2 THEN c * (1 - bb / 10000) END, CASE WHEN NOT stop2 THEN c * (1 + bb / 10000) END,
   CASE WHEN mid IS NULL OR stop2 THEN NULL WHEN h2 THEN 0 ELSE bsz END, CASE WHEN mid IS NULL OR stop2 THEN NULL WHEN h2 THEN 0 ELSE asz END FROM (
   SELECT *, mid * (1 - inv * 2 * CASE WHEN p2 THEN 2 ELSE 1 END / 10000) AS c, CASE WHEN p2 THEN 6 ELSE 5 END AS bb,
    CASE WHEN p2 THEN least(b0, greatest(0, 2 - inv)) ELSE b0 END AS bsz, CASE WHEN p2 THEN least(a0, greatest(0, 2 + inv)) ELSE a0 END AS asz FROM (
   SELECT *, COALESCE(dd <= -150, false) AS stop2, COALESCE(amr > 0.02, false) AS h2, ms < 2.0 OR abs(sv) > 45 AS p2,
    2 * CASE WHEN mb <= -1 THEN 0.25::DOUBLE ELSE 1 END * CASE WHEN imb <= -0.4::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS b0,
    2 * CASE WHEN sv <= -45 THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN mb >= 1 THEN 0.25::DOUBLE ELSE 1 END * CASE WHEN imb >= 0.4::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS a0 FROM states))""", _Q)
def b14(spark: SparkSession, sf: str) -> DataFrame:
    return qt.quotes(qt.with_variants(states(spark, sf), PARAMS)).select("run_id", "book_event_id", "variant", "halt", *_Q.split())


@query("e9_post_pull_unwind_latch", "ledger", """WITH s AS (SELECT run_id, book_event_id, block_ts_ms, position AS inv, pull_triggered AS pull, NOT pull_triggered AND (stop_triggered OR mark_price IS NULL) AS clears FROM ledger),
  i AS (SELECT *, sum((pull OR clears)::INT) OVER (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id) AS island FROM s),
  j AS (SELECT *, bool_or(pull) OVER (PARTITION BY run_id, island) AS from_pull, min(CASE WHEN NOT (pull OR clears) THEN abs(inv) END) OVER (PARTITION BY run_id, island ORDER BY block_ts_ms, book_event_id) AS least_inv FROM i)
  SELECT run_id, book_event_id, NOT (pull OR clears) AND from_pull AND COALESCE(least_inv > 1.0, false) AS active FROM j""")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    clears = F.col("stop_triggered") | F.col("mark_price").isNull()
    rows = v.ledger(spark, sf).select(
        "run_id", *bl.BLOCK, F.col("position").alias("inv"), F.col("pull_triggered").alias("pull"), (~F.col("pull_triggered") & clears).alias("clears")
    )
    out = of.unwind_latch(rows, ["run_id"], bl.BLOCK, 1.0)
    return out.select("run_id", "book_event_id", F.col("post_pull_unwind_active").alias("active"))


def block_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Two post-only orders per block around mid, one of them sometimes without a price."""
    b = v.books(spark, sf).select("symbol", F.col("event_id").alias("book_event_id"), *bl.TOP)
    m = bk.mid(F.col("bid_px"), F.col("ask_px"))
    one = lambda side, d, size: F.struct(
        F.lit(side).alias("side"), F.when(F.col("book_event_id") % 9 != 0, F.round(m + d, 4)).alias("price"), F.lit(size).alias("size")
    )
    rows = b.select("*", F.inline(F.array(one("buy", 0.02, 3.0), one("sell", -0.01, 20.0))))
    rows = rows.withColumns(
        {"order_id": F.concat_ws(":", F.col("book_event_id").cast("string"), "side"), "post_only": F.col("book_event_id") % 5 != 0}
    )
    return of.with_limit(rows)


def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    return bl.bucket_trades(v.trades(spark, sf), v.books(spark, sf))


v.CTES["block_orders"] = (
    ["books"],
    """SELECT *, COALESCE(price, CASE WHEN side = 'buy' THEN ask_px ELSE bid_px END) AS limit_px, event_id || ':' || side AS order_id, event_id % 5 <> 0 AS post_only FROM (
    SELECT symbol, event_id, event_id AS book_event_id, bid_px, bid_sz, ask_px, ask_sz, side, size, CASE WHEN event_id % 9 <> 0 THEN round((bid_px + ask_px) / 2 + d, 4) END AS price
    FROM books, (VALUES ('buy', 0.02::DOUBLE, 3.0::DOUBLE), ('sell', -0.01::DOUBLE, 20.0::DOUBLE)) t(side, d, size))""",
)
v.CTES["eligible"] = (
    ["block_orders", "bucketed"],
    """SELECT o.*, t.vol, t.val, COALESCE(t.n, 0) AS trades_used, t.vol3, t.val3, COALESCE(t.n3, 0) AS n3 FROM block_orders o LEFT JOIN (
    SELECT order_id, sum(sz) AS vol, sum(px * sz) AS val, count(*) AS n, sum(sz) FILTER (i <= 3) AS vol3, sum(px * sz) FILTER (i <= 3) AS val3, count(*) FILTER (i <= 3) AS n3 FROM (
    SELECT order_id, sz, px, row_number() OVER (PARTITION BY order_id ORDER BY ts_ms, t.event_id) AS i FROM block_orders o JOIN bucketed t ON t.symbol = o.symbol AND t.book_event_id = o.book_event_id
      AND ((o.side = 'buy' AND t.side = 'sell' AND t.px <= o.limit_px) OR (o.side = 'sell' AND t.side = 'buy' AND t.px >= o.limit_px))) GROUP BY ALL) t USING (order_id)""",
)


@query("c16_j2_fill_upper", "eligible", "SELECT order_id, CASE WHEN vol IS NOT NULL THEN least(size, vol) END AS fill_size, val / vol AS fill_price, trades_used FROM eligible", "fill_size fill_price")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return of.evaluate(block_orders(spark, sf), bucketed(spark, sf)).select("order_id", "fill_size", "fill_price", "trades_used")


@query("c16_j2_fill_lower_alphas", "eligible", "SELECT order_id, alpha, CASE WHEN vol3 IS NOT NULL THEN least(size, vol3 * alpha) END AS fill_size, val3 / vol3 AS fill_price, n3 AS trades_used FROM eligible, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) a(alpha)", "alpha fill_size fill_price")
def c16l(spark: SparkSession, sf: str) -> DataFrame:
    out = of.evaluate(block_orders(spark, sf), bucketed(spark, sf), model="lower", alpha=[0.3, 0.5, 0.7], prints=3)
    return out.select("order_id", "alpha", "fill_size", "fill_price", "trades_used")


@query("b10_crosses_post_only", "block_orders", """SELECT order_id, COALESCE(CASE WHEN side = 'buy' THEN COALESCE(price, bid_px) >= ask_px ELSE COALESCE(price, ask_px) <= bid_px END, false) AS crosses FROM block_orders""")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    rows = block_orders(spark, sf)
    return rows.select("order_id", qt.crosses_post_only(F.col("side"), F.col("price"), F.col("bid_px"), F.col("ask_px")).alias("crosses"))


@query("b30_b31_order_status_and_fees", "eligible", """WITH s AS (SELECT *, CASE WHEN post_only AND COALESCE(CASE WHEN side = 'buy' THEN COALESCE(price, bid_px) >= ask_px ELSE COALESCE(price, ask_px) <= bid_px END, false) THEN 'invalid_cross'
  WHEN limit_px IS NULL THEN 'invalid_no_liquidity' WHEN vol IS NULL THEN 'no_fill' ELSE 'filled' END AS status FROM eligible)
  SELECT symbol, status, count(*) AS n, COALESCE(sum(CASE WHEN status = 'filled' AND post_only THEN least(size, vol) * val / vol * 0.00002::DOUBLE END), 0) AS rebate,
  COALESCE(sum(CASE WHEN status = 'filled' AND NOT post_only THEN least(size, vol) * val / vol * 0.00035::DOUBLE END), 0) AS fee FROM s GROUP BY ALL""", "rebate fee")
def b30(spark: SparkSession, sf: str) -> DataFrame:
    rows = of.order_status(of.evaluate(block_orders(spark, sf), bucketed(spark, sf)))
    paid = rows.withColumns(of.fees(F.col("fill_size"), F.col("fill_price"), F.col("post_only"), 0.2, 3.5))
    filled = F.col("status") == "filled"
    total = lambda c: F.coalesce(F.sum(F.when(filled, F.col(c))), F.lit(0.0)).alias(c)
    return paid.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"), total("rebate"), total("fee"))
