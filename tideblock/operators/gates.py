"""Pass and fail rules over run KPIs, and the roll-up over many runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideblock.operators import ordered, quantiles
from tideblock.operators.runlogs import RUN, batch_gaps

# Fixed values of the gates.
MAX_TAKER_SHARE = 0.001
MIN_NET_P10 = -5.0
WARN_MARKOUT = -5.0
GATE_FILLS = 10
GATE_NOTIONAL = 300.0
MIN_WIN_RATE = 0.55
SHADOW_TRIGGER_RANGE = (0.03, 0.10)
SHADOW_MIN_TOP_CHANGES = 20
SHADOW_BATCH_MS = 100
SHADOW_SIZE_EPS = 1e-12
PHASE_MAX_MARGIN_ERRORS = 1
PHASE_MAX_REJECT_SHARE = 0.05


def _on(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def shadow_gate(market: DataFrame, decisions: DataFrame, orders: DataFrame) -> DataFrame:
    """Checks of a dry run: trigger rate, boost sizes, crossings, batch spacing and reconnect cancels."""
    low, high = SHADOW_TRIGGER_RANGE
    states = market.groupBy(*RUN).agg(
        F.avg(_on("boost_active").cast("double")).alias("boost_rate"),
        F.count_if(_on("reconnect")).alias("reconnects"),
        F.count_if(_on("top_px_change")).alias("top_changes"),
    )
    base, bid, ask = (F.coalesce(c, F.lit(0.0)) for c in ("base_size", "final_bid_sz", "final_ask_sz"))
    grown = (bid > base + SHADOW_SIZE_EPS) & (ask > base + SHADOW_SIZE_EPS)
    checks = decisions.groupBy(*RUN).agg(
        F.count_if(_on("boost_active")).alias("boost_records"),
        F.count_if(_on("boost_active") & grown).alias("boost_applied"),
        F.count_if(_on("crossed")).alias("crossed"),
    )
    boosted = decisions.filter(_on("boost_active") & (base > 0))
    ratios = boosted.select(*RUN, F.explode(F.array(bid / base, ask / base)).alias("ratio"))
    median = quantiles.quantile_columns(ratios, RUN, "ratio", {"ratio_median": 0.5})
    cancels = orders.groupBy(*RUN).agg(
        F.count_if((F.col("action") == "cancel_all") & (F.col("reason") == "reconnect")).alias("reconnect_cancels")
    )
    out = states
    for part in (checks, median, batch_gaps(orders), cancels):
        out = out.join(part, RUN, "left")
    out = out.fillna(0, ["boost_records", "boost_applied", "crossed", "reconnect_cancels"])
    out = out.withColumns(
        {
            "trigger_ok": F.col("boost_rate").between(low, high),
            "trigger_inconclusive": F.col("top_changes") < SHADOW_MIN_TOP_CHANGES,
            "size_ok": F.col("boost_applied") == F.col("boost_records"),
            "crossed_ok": F.col("crossed") == 0,
            "batch_ok": F.coalesce(F.col("min_batch_gap_ms") >= SHADOW_BATCH_MS, F.lit(True)),
            "reconnect_ok": (F.col("reconnects") == 0) | (F.col("reconnect_cancels") >= F.col("reconnects")),
        }
    )
    return out.withColumn(
        "passed",
        (F.col("trigger_inconclusive") | F.col("trigger_ok"))
        & F.col("size_ok") & F.col("crossed_ok") & F.col("batch_ok") & F.col("reconnect_ok"),
    )


def run_status(reports: DataFrame) -> DataFrame:
    """``gate_b`` and ``status`` of each run report."""
    gate = (
        (F.coalesce("fills_count", F.lit(0)) >= GATE_FILLS)
        & (F.coalesce("notional_sum", F.lit(0.0)) >= GATE_NOTIONAL)
        & (F.coalesce("fills_joined_count", F.lit(0)) > 0)
    )
    hard = (
        _on("taker_guard_trip")
        | F.coalesce(F.col("taker_notional_share") > MAX_TAKER_SHARE, F.lit(False))
        | F.coalesce(F.col("net_p10") < MIN_NET_P10, F.lit(False))
    )
    status = (
        F.when(hard, F.lit("HARD_FAIL"))
        .when(~gate | F.col("net_med").isNull(), F.lit("INCONCLUSIVE"))
        .when(F.col("net_med") > 0, F.lit("PASS"))
        .otherwise(F.lit("FAIL"))
    )
    return reports.withColumns({"gate_b": gate, "status": status})


def latest_runs(reports: DataFrame, n: int, group: list[str] | None = None) -> DataFrame:
    """The ``n`` newest reports, per group when given. One row per run, so ranking is small."""
    if not group:
        return reports.orderBy(F.col("mtime").desc(), F.col("run_id").desc()).limit(n)
    w = Window.partitionBy(*group).orderBy(F.col("mtime").desc(), F.col("run_id").desc())
    return reports.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def monitor_rollup(statuses: DataFrame, window: int = 10) -> DataFrame:
    """Medians, win rate and warnings over the newest gate-B runs, and the verdict; one row.

    Works on one row per run, cut to ``window`` rows before the ordered step.
    """
    warn = F.coalesce(F.col("markout30_med") < WARN_MARKOUT, F.lit(False))
    recent = latest_runs(statuses.filter("gate_b"), window).withColumn("warn", warn)
    newest = Window.orderBy(F.col("mtime").desc(), F.col("run_id").desc())
    pairs = recent.withColumn("_again", F.col("warn") & F.lag("warn", 1, False).over(newest))
    rolled = pairs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.percentile("net_med", F.lit(0.5)).alias("net_med_median"),
        F.avg(F.when(F.col("net_med").isNotNull(), (F.col("net_med") > 0).cast("double"))).alias("net_med_win_rate"),
        F.min("net_p10").alias("net_p10_min"),
        F.count_if("warn").alias("warn_count"),
        F.coalesce(F.bool_or("_again"), F.lit(False)).alias("warn_consecutive"),
        F.count_if(_on("taker_guard_trip")).alias("taker_guard_trips"),
    )
    return candidate_verdict(
        rolled.withColumn("need_action", (F.col("warn_count") >= 2) | F.col("warn_consecutive")), window
    )


def candidate_verdict(rolled: DataFrame, window: int = 10) -> DataFrame:
    """PASS with a full window, a positive median and a sufficient win rate."""
    good = (F.col("net_med_median") > 0) & (F.col("net_med_win_rate") >= MIN_WIN_RATE)
    return rolled.withColumn(
        "verdict",
        F.when(F.col("runs") < window, F.lit("INCONCLUSIVE")).when(good, F.lit("PASS")).otherwise(F.lit("FAIL")),
    )


def phase_gate(counts: DataFrame) -> DataFrame:
    """Operational limits; the post-only share is advisory."""
    share = F.try_divide(F.col("post_only_rejects").cast("double"), F.col("sent").cast("double"))
    return counts.withColumns(
        {
            "passed": (F.col("margin_errors") <= PHASE_MAX_MARGIN_ERRORS)
            & (F.col("rate_limit_errors") == 0)
            & (F.col("cannot_modify_errors") == 0)
            & (F.col("taker_fills") == 0),
            "post_only_share": share,
            "post_only_ok": F.coalesce(share <= PHASE_MAX_REJECT_SHARE, F.lit(True)),
        }
    )


def consecutive_flags(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Whether two adjacent rows of a key are both flagged."""
    near = ordered.over(rows, keys, order, _p=ordered.previous(_on(flag)))
    return near.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("_p") & _on(flag)), F.lit(False)).alias("consecutive"))
