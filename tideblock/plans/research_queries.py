"""Queries over targets, edge screens, flow checks and risk windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import book as bk
from tideblock.operators import blocks as bl
from tideblock.operators import research as rs
from tideblock.operators import runs as rn
from tideblock.plans import views as v
from tideblock.plans.catalog import query

# Events are minutes apart, so horizons are hours.
HORIZONS_S = [3600, 14400, 86400]
SCREENED = ["imbalance", "market_spread_bps", "micro_bias_bps", "micro_pos", "microprice"]
TARGET = "y_ret_14400s"

v.CTES.update(
    {
        "quotes": (
            ["books"],
            """SELECT *, (bid_px + ask_px) / 2 AS mid, ask_px - bid_px AS spread, (bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz) AS microprice,
            (bid_sz - ask_sz) / (bid_sz + ask_sz) AS imbalance, (microprice - mid) / mid * 1e4 AS micro_bias_bps, (microprice - mid) / spread AS micro_pos,
            1e4 * spread / mid AS market_spread_bps, ts_ms AS block_ts_ms, event_id AS book_event_id FROM books""",
        ),
        "targets": (
            ["quotes"],
            """SELECT p.*, f.fmid - p.mid AS y_markout, (f.fmid - p.mid) / p.mid AS y_ret FROM
            (SELECT q.*, h AS horizon_s, ts_ms + h * 1000 AS due FROM quotes q, (VALUES (3600), (14400), (86400)) t(h)) p
            ASOF LEFT JOIN (SELECT symbol, ts_ms AS fts, arg_min({m: mid}, event_id).m AS fmid FROM quotes GROUP BY ALL) f
            ON p.symbol = f.symbol AND p.due <= f.fts""",
        ),
        "split": (
            ["quotes"],
            """SELECT q.*, b.s AS start_ms, b.te, b.ve, b.e AS end_ms, CASE WHEN ts_ms < te THEN 'train' WHEN ts_ms < ve THEN 'valid' ELSE 'test' END AS split
            FROM quotes q JOIN (SELECT symbol, min(ts_ms) AS s, max(ts_ms) AS e, s + CAST(floor(greatest(e - s, 1) * 0.7::DOUBLE) AS BIGINT) AS te,
            s + CAST(floor(greatest(e - s, 1) * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) AS ve FROM quotes GROUP BY ALL) b USING (symbol)""",
        ),
        "edge_rows": (
            ["split", "targets"],
            """SELECT u.symbol, u.block_ts_ms, u.book_event_id, u.feature, u.x, t.y_ret AS y FROM
            (UNPIVOT (SELECT symbol, block_ts_ms, book_event_id, imbalance, market_spread_bps, micro_bias_bps, micro_pos, microprice FROM split WHERE split = 'train')
             ON imbalance, market_spread_bps, micro_bias_bps, micro_pos, microprice INTO NAME feature VALUE x) u
            JOIN targets t ON t.symbol = u.symbol AND t.book_event_id = u.book_event_id AND t.horizon_s = 14400 WHERE t.y_ret IS NOT NULL AND u.x IS NOT NULL""",
        ),
        "edge_z": (
            ["edge_rows"],
            """SELECT e.*, (x - mx) / CASE WHEN sx = 0 THEN 1 ELSE sx END * ((y - my) / CASE WHEN sy = 0 THEN 1 ELSE sy END) AS z FROM edge_rows e
            JOIN (SELECT symbol, feature, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM edge_rows GROUP BY ALL) m USING (symbol, feature)""",
        ),
        "edge_ic": (
            ["edge_z"],
            """SELECT symbol, feature, count(*) AS n, any_value(m) AS ic, sqrt(greatest((sum(d * d) + 2 * (5.0::DOUBLE / 6 * COALESCE(sum(d * d1), 0) + 4.0::DOUBLE / 6 * COALESCE(sum(d * d2), 0)
            + 3.0::DOUBLE / 6 * COALESCE(sum(d * d3), 0) + 2.0::DOUBLE / 6 * COALESCE(sum(d * d4), 0) + 1.0::DOUBLE / 6 * COALESCE(sum(d * d5), 0))) / count(*), 0) / count(*)) AS se FROM (
            SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3, lag(d, 4) OVER w AS d4, lag(d, 5) OVER w AS d5 FROM (
            SELECT *, avg(z) OVER (PARTITION BY symbol, feature) AS m, z - m AS d FROM edge_z)
            WINDOW w AS (PARTITION BY symbol, feature ORDER BY block_ts_ms, book_event_id)) GROUP BY ALL""",
        ),
        "edge_quantiles": (
            ["edge_rows"],
            """SELECT e.symbol, e.feature, avg(y) FILTER (x <= lo) AS mean_low, avg(y) FILTER (x > lo AND x < hi) AS mean_mid, avg(y) FILTER (x >= hi) AS mean_high,
            (avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo)) * 10000 AS effect_bps FROM edge_rows e
            JOIN (SELECT symbol, feature, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM edge_rows GROUP BY ALL) USING (symbol, feature) GROUP BY ALL""",
        ),
        "risk_rows": (
            ["ledger"],
            """SELECT *, risk_delta <= cut AND risk_delta IS NOT NULL AS risk FROM (SELECT *, quantile_cont(risk_delta, 0.1) OVER (PARTITION BY run_id) AS cut FROM (
            SELECT *, total_pnl - COALESCE(lag(total_pnl) OVER (PARTITION BY run_id ORDER BY block_ts_ms, book_event_id), 0) AS risk_delta FROM ledger))""",
        ),
        "risk_long": (
            ["risk_rows"],
            """SELECT run_id, feature, x, risk, risk_delta AS delta FROM (UNPIVOT (SELECT run_id, risk, risk_delta, market_spread_bps, abs(signed_volume) AS abs_signed_volume, abs_mid_ret FROM risk_rows)
            ON market_spread_bps, abs_signed_volume, abs_mid_ret INTO NAME feature VALUE x)""",
        ),
    }
)


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    named = v.books(spark, sf).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    return named.withColumns(bk.book_columns(*bl.TOP)).drop("run_id", "ts")


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    return rs.assign_split(rs.wide_targets(quotes(spark, sf), [14400]))


def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    train = dataset(spark, sf).filter(F.col("split") == "train").select("symbol", *bl.BLOCK, TARGET, *SCREENED)
    train = scratch.keep(train, "train")
    return rs.feature_rows(train, SCREENED, TARGET, ["symbol", *bl.BLOCK])


@query("e16_mean_markout_by_symbol", "targets", "SELECT symbol, horizon_s, count(y_markout) AS n, avg(y_markout) AS mean_markout, avg(y_ret) AS mean_ret FROM targets GROUP BY ALL",
       "mean_markout mean_ret", "horizon_s")
def mean_markout(spark: SparkSession, sf: str) -> DataFrame:
    rows = rs.targets(quotes(spark, sf).select("symbol", *bl.BLOCK, "mid"), HORIZONS_S)
    return rows.groupBy("symbol", "horizon_s").agg(
        F.count("y_markout").alias("n"), F.avg("y_markout").alias("mean_markout"), F.avg("y_ret").alias("mean_ret")
    )


@query("c4_forward_target", "targets", "SELECT symbol, book_event_id, horizon_s, y_markout, y_ret FROM targets", "y_markout y_ret", "horizon_s")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    return rs.targets(quotes(spark, sf), HORIZONS_S).select("symbol", "book_event_id", "horizon_s", "y_markout", "y_ret")


@query("e16_targets_wide", "targets", """SELECT symbol, book_event_id, max(y_markout) FILTER (horizon_s = 3600) AS y_markout_3600s, max(y_ret) FILTER (horizon_s = 3600) AS y_ret_3600s,
  max(y_markout) FILTER (horizon_s = 86400) AS y_markout_86400s, max(y_ret) FILTER (horizon_s = 86400) AS y_ret_86400s FROM targets GROUP BY ALL""",
       "y_markout_3600s y_ret_3600s y_markout_86400s y_ret_86400s")
def e16w(spark: SparkSession, sf: str) -> DataFrame:
    out = rs.wide_targets(quotes(spark, sf), [3600, 86400])
    return out.select("symbol", "book_event_id", "y_markout_3600s", "y_ret_3600s", "y_markout_86400s", "y_ret_86400s")


@query("e15_chrono_split", "split", "SELECT symbol, split, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM split GROUP BY ALL")
def e15(spark: SparkSession, sf: str) -> DataFrame:
    return rs.assign_split(quotes(spark, sf)).groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("block_ts_ms").alias("first_ms"), F.max("block_ts_ms").alias("last_ms")
    )


@query("e15_split_table", "split", """SELECT DISTINCT symbol, u.split, u.a AS start_ms, u.b AS end_ms FROM split,
  LATERAL (VALUES ('train', start_ms, te), ('valid', te, ve), ('test', ve, end_ms)) u(split, a, b)""")
def e15t(spark: SparkSession, sf: str) -> DataFrame:
    return rs.split_table(rs.split_bounds(quotes(spark, sf)))


@query("b27_numeric_features", "", """SELECT column_name AS feature FROM (DESCRIBE lineitem) WHERE (column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%') AND column_name NOT IN ('l_extendedprice', 'l_orderkey')""")
def b27(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric columns of a given table that have finite pairs with the target, which the table's schema decides."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    names = rs.numeric_features(rows, ["l_extendedprice", "l_orderkey"])
    return rs.feature_rows(rows, names, "l_extendedprice", ["l_orderkey"]).select("feature").distinct()


@query("d15_ic", "edge_ic", "SELECT symbol, feature, n, ic FROM edge_ic", "ic")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    z = rs.z_products(edge_rows(spark, sf), ["symbol", "feature"])
    return z.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("ic"))


@query("d16_newey_west_se", "edge_ic", "SELECT symbol, feature, n, ic AS mean, se FROM edge_ic", "mean se")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    z = rs.z_products(edge_rows(spark, sf), ["symbol", "feature"])
    return rs.newey_west(z, ["symbol", "feature"], bl.BLOCK, "z")


@query("d17_d19_quantile_effect", "edge_quantiles", "SELECT * FROM edge_quantiles", "mean_low mean_mid mean_high effect_bps")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    return rs.quantile_effect(edge_rows(spark, sf), ["symbol", "feature"])


@query("d18_edge_screen", "edge_ic edge_quantiles", """SELECT symbol, feature, n, ic, ic - 1.96::DOUBLE * se AS ci_low, ic + 1.96::DOUBLE * se AS ci_high, effect_bps, abs(ic) >= 0.01 AS keep
  FROM edge_ic JOIN edge_quantiles USING (symbol, feature)""", "ic ci_low ci_high effect_bps")
def d18(spark: SparkSession, sf: str) -> DataFrame:
    return rs.edge_screen(dataset(spark, sf), SCREENED, TARGET, ["symbol"])


@query("e7_cumulative_ic", "edge_z", "SELECT symbol, feature, book_event_id, avg(z) OVER (PARTITION BY symbol, feature ORDER BY block_ts_ms, book_event_id ROWS UNBOUNDED PRECEDING) AS cum_ic FROM edge_z", "cum_ic")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    out = rs.cumulative_ic(edge_rows(spark, sf), ["symbol", "feature"], bl.BLOCK)
    return out.select("symbol", "feature", "book_event_id", "cum_ic")


_FLOW = "ret_now_pos ret_now_neg ret_next_pos ret_next_neg corr_now corr_next"


@query("d20_flow_sign_check", "state", """SELECT symbol, count(*) AS n, count(*) FILTER (sv > 0) AS n_pos, count(*) FILTER (sv < 0) AS n_neg,
  avg(mid_ret) FILTER (sv > 0) AS ret_now_pos, avg(mid_ret) FILTER (sv < 0) AS ret_now_neg, avg(fwd) FILTER (sv > 0) AS ret_next_pos, avg(fwd) FILTER (sv < 0) AS ret_next_neg,
  corr(sv, mid_ret) AS corr_now, corr(sv, fwd) AS corr_next FROM (SELECT *, signed_volume_lenient AS sv, (next_mid - mid) / mid AS fwd FROM state) GROUP BY ALL""", _FLOW)
def d20(spark: SparkSession, sf: str) -> DataFrame:
    from tideblock.plans.market_queries import blocks

    rows = blocks(spark, sf).withColumn("mid", bk.mid(F.col("bid_px"), F.col("ask_px")))
    return rs.flow_sign(rows.select("symbol", *bl.BLOCK, "mid", "signed_volume_lenient"), flow="signed_volume_lenient")


@query("d21_abs_quantiles", "ledger", """SELECT run_id, p, q FROM (SELECT run_id, unnest([0.5, 0.9, 0.95, 0.99]) AS p,
  unnest(quantile_cont(abs(signed_volume), [0.5, 0.9, 0.95, 0.99])) AS q FROM ledger GROUP BY run_id)""", "p q")
def d21(spark: SparkSession, sf: str) -> DataFrame:
    from tideblock.operators.quantiles import quantiles

    return quantiles(v.ledger(spark, sf), ["run_id"], F.abs("signed_volume"), [0.5, 0.9, 0.95, 0.99])


def risk_rows(spark: SparkSession, sf: str) -> DataFrame:
    narrow = v.ledger(spark, sf).select("run_id", *bl.BLOCK, "total_pnl", "market_spread_bps", "signed_volume", "abs_mid_ret")
    rows = rn.increments(narrow, ["total_pnl"]).withColumnRenamed("delta_total_pnl", "pnl_delta")
    return rs.risk_label(rows, rn.RUN, 0.10)


def risk_long(spark: SparkSession, sf: str) -> DataFrame:
    """(run, feature, x, risk, delta) for the three candidate features."""
    rows = risk_rows(spark, sf)
    x = {"market_spread_bps": F.col("market_spread_bps"), "abs_signed_volume": F.abs("signed_volume"), "abs_mid_ret": F.col("abs_mid_ret")}
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("x")) for n, c in x.items()])
    return rows.select("run_id", "risk", F.col("pnl_delta").alias("delta"), F.inline(pairs)).filter(F.col("x").isNotNull())


@query("d23_risk_label", "risk_rows", "SELECT run_id, book_event_id, risk_delta AS pnl_delta, risk FROM risk_rows", "pnl_delta")
def d23(spark: SparkSession, sf: str) -> DataFrame:
    return risk_rows(spark, sf).select("run_id", "book_event_id", "pnl_delta", "risk")


_GRID = """windows AS (SELECT run_id, feature, p, m AS mode, thr AS threshold, count(*) AS total, count(*) FILTER (win) AS n, count(*) FILTER (win AND risk) AS tp,
    count(*) FILTER (risk) AS allrisk, avg(delta) FILTER (win) AS mean_delta_in, avg(delta) FILTER (NOT win) AS mean_delta_out FROM (
    SELECT l.*, c.p, c.thr, m, CASE WHEN m = 'gt' THEN x >= thr ELSE x <= thr END AS win FROM {rows} l JOIN cuts c USING (run_id, feature), (VALUES ('gt'), ('lt')) modes(m)) GROUP BY ALL),
  scored AS (SELECT *, n / total AS window_rate, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS precision, CASE WHEN allrisk > 0 THEN tp / allrisk ELSE 0 END AS recall,
    CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / allrisk) / (tp / n + tp / allrisk) ELSE 0 END AS f1 FROM windows)"""
_SCORES = "threshold window_rate precision recall f1 mean_delta_in mean_delta_out"


@query("d24_risk_window_f1", "risk_long", """WITH ps AS (SELECT i / 100 AS p FROM range(1, 100) r(i)),
  cuts AS (SELECT run_id, feature, unnest([i / 100 FOR i IN range(1, 100)]) AS p, unnest(quantile_cont(x, [i / 100 FOR i IN range(1, 100)])) AS thr FROM risk_long GROUP BY run_id, feature), """
       + _GRID.format(rows="risk_long") + """ SELECT run_id, feature, p, mode, threshold, window_rate, precision, recall, f1, mean_delta_in, mean_delta_out FROM scored
  QUALIFY row_number() OVER (PARTITION BY run_id, feature ORDER BY f1 DESC, p, mode) = 1""", "p " + _SCORES)
def d24(spark: SparkSession, sf: str) -> DataFrame:
    place = ["run_id", "feature"]
    points = [i / 100 for i in range(1, 100)]
    return rs.best_window(rs.threshold_windows(risk_long(spark, sf), place, points), place)


@query("d25_f6_risk_window_fixed_rate", "risk_long", """WITH known AS (SELECT * FROM risk_long WHERE delta IS NOT NULL),
  cuts AS (SELECT run_id, feature, unnest([0.05, 0.1, 0.9, 0.95]) AS p, unnest(quantile_cont(x, [0.05, 0.1, 0.9, 0.95])) AS thr FROM known GROUP BY run_id, feature), """
       + _GRID.format(rows="known") + """ SELECT run_id, feature, CASE WHEN mode = 'gt' THEN round(1 - p, 2) ELSE p END AS target_rate, mode, threshold, window_rate, precision, recall, f1, mean_delta_in, mean_delta_out
  FROM scored WHERE (mode = 'gt') = (p > 0.5) ORDER BY feature, target_rate, mode""", "target_rate " + _SCORES)
def d25(spark: SparkSession, sf: str) -> DataFrame:
    out = rs.fixed_rate_windows(risk_long(spark, sf), ["run_id", "feature"], [0.05, 0.10])
    return out.orderBy("feature", "target_rate", "mode")
