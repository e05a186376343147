"""Metrics of runs from their ledgers and fills, window splits, comparisons and A/B verdicts.

Ledgers have one row per (run, block); ``RUN`` are the keys of a run, which may include a variant and a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import values as val
from tideblock.operators import ordered, quantiles
from tideblock.operators.asof import Ask, Source, lookups
from tideblock.operators.blocks import BLOCK
from tideblock.operators.research import guarded_corr

RUN = ["run_id"]
DELTA_COLUMNS = ["total_pnl", "price_pnl", "unrealized_pnl", "fees", "rebates", "funding"]
FLAGS = ["stop_triggered", "pull_triggered", "halt_triggered"]

# Fixed values of the A/B acceptance rule.
MIN_WIN_RATE = 0.55


def notional(price: str = "price", size: str = "size") -> Column:
    return F.abs(F.col(price)) * F.abs(F.col(size))


def run_basics(ledger: DataFrame, fills: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Blocks, fills, notional, fill rate (two orders per block), final pnl."""
    position = F.struct(*BLOCK)
    runs = ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_blocks"), F.max_by("total_pnl", position).alias("pnl")
    )
    deals = fills.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_fills"), F.sum(notional()).alias("notional_traded"))
    out = runs.join(deals, list(keys), "left")
    count = F.coalesce("num_fills", F.lit(0).cast("bigint"))
    return out.select(
        *keys, "num_blocks", count.alias("num_fills"),
        F.coalesce("notional_traded", F.lit(0.0)).alias("notional_traded"),
        F.least(F.lit(1.0), count / (F.col("num_blocks") * 2)).alias("fill_rate"), "pnl",
    )


def inventory_stats(ledger: DataFrame, keys: Sequence[str] = RUN, points: dict[str, float] | None = None) -> DataFrame:
    points = points or {"p10": 0.10, "p90": 0.90, "p95": 0.95}
    basic = ledger.groupBy(*keys).agg(
        F.avg("position").alias("mean"), F.max(F.abs("position")).alias("max_abs")
    )
    return basic.join(quantiles.quantile_columns(ledger, keys, "position", points), list(keys), "left")


def fee_breakdown(ledger: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Final cumulative fees, rebates and funding."""
    position = F.struct(*BLOCK)
    return ledger.groupBy(*keys).agg(*[F.max_by(c, position).alias(c) for c in ("fees", "rebates", "funding")])


def trigger_counts(ledger: DataFrame, keys: Sequence[str] = RUN, flags: Sequence[str] = FLAGS) -> DataFrame:
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return ledger.groupBy(*keys).agg(
        *[F.count_if(on(c)).alias(f"{c}_count") for c in flags],
        *[F.avg(on(c).cast("double")).alias(f"{c}_rate") for c in flags],
    )


def drawdown(ledger: DataFrame, keys: Sequence[str] = RUN, from_zero: bool = False) -> DataFrame:
    """Pnl below its running peak; ``from_zero`` starts the peak at zero."""
    run = ordered.over(ledger, keys, BLOCK, _peak=ordered.running_max(F.col("total_pnl")))
    peak = F.greatest(F.col("_peak"), F.lit(0.0)) if from_zero else F.col("_peak")
    return run.withColumn("drawdown", F.col("total_pnl") - peak).drop("_peak")


def max_drawdown(ledger: DataFrame, keys: Sequence[str] = RUN, from_zero: bool = False) -> DataFrame:
    return drawdown(ledger.select(*keys, *BLOCK, "total_pnl"), keys, from_zero).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def increments(ledger: DataFrame, columns: Sequence[str], keys: Sequence[str] = RUN, skip_null: bool = False) -> DataFrame:
    """``delta_{c}`` against the row before (first against 0); with ``skip_null`` against the last non-null row."""
    kind = ordered.last_before if skip_null else ordered.previous
    near = ordered.over(ledger, keys, BLOCK, **{f"_p_{c}": kind(F.col(c)) for c in columns})
    return near.withColumns(
        {f"delta_{c}": F.col(c) - F.coalesce(F.col(f"_p_{c}"), F.lit(0.0)) for c in columns}
    ).drop(*[f"_p_{c}" for c in columns])


def pnl_when(ledger: DataFrame, flags: Sequence[str] = FLAGS, keys: Sequence[str] = RUN) -> DataFrame:
    """Sum of pnl increments inside and outside each flag."""
    rows = increments(ledger.select(*keys, *BLOCK, "total_pnl", *flags), ["total_pnl"], keys)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    d = F.col("delta_total_pnl")
    return rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(on(c), d)), F.lit(0.0)).alias(f"pnl_in_{c}") for c in flags],
        *[F.coalesce(F.sum(F.when(~on(c), d)), F.lit(0.0)).alias(f"pnl_out_{c}") for c in flags],
    )


def fills_when(ledger: DataFrame, fills: DataFrame, flag: str, keys: Sequence[str] = RUN, block: str = "book_event_id") -> DataFrame:
    """Count and notional of fills in blocks of their run where the flag is set."""
    on = ledger.filter(F.col(flag)).select(*keys, block).distinct()
    hit = fills.join(on, [*keys, block], "left_semi")
    return hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("fills"), F.sum(notional()).alias("notional"))


def mid_series(rows: DataFrame, mid: str, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, ts, id, mid) rows with both time and mid, the quotes side of markouts."""
    return rows.filter(F.col("block_ts_ms").isNotNull() & val.finite(F.col(mid))).select(
        *keys, F.col("block_ts_ms").alias("mid_ts_ms"), F.col("book_event_id").alias("mid_id"),
        F.col(mid).cast("double").alias("mid"),
    )


def fill_outcomes(fills: DataFrame, mids: DataFrame, horizons_ms: Sequence[int], keys: Sequence[str] = RUN) -> DataFrame:
    """Per (fill, horizon): markout (mid change) and realized spread (future mid against price), signed by side.

    Mid now is the last at or before the fill, the future mid the first at or after fill + horizon.
    """
    at = F.col("block_ts_ms")
    asks = {"_now": Ask("mid", at)} | {f"_in{h}": Ask("mid", at + int(h), "forward") for h in horizons_ms}
    hit = lookups(fills.filter(F.col("side").isNotNull()), keys, asks, {"mid": Source(mids, "mid_ts_ms", ["mid"], ["mid_id"])})
    each = F.array(*[F.struct(F.lit(int(h)).cast("bigint").alias("horizon_ms"), F.col(f"_in{h}.mid").alias("_future")) for h in horizons_ms])
    sign = F.when(F.col("side") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    return hit.select(*fills.columns, "_now", F.inline(each)).withColumns(
        {
            "markout": sign * (F.col("_future") - F.col("_now.mid")),
            "realized_spread": sign * (F.col("_future") - F.col("price")),
        }
    ).drop("_now", "_future")


def window_keys(ledger: DataFrame, flag: Column, block: str = "book_event_id", run: Column | None = None) -> DataFrame:
    """Distinct blocks where the flag is set, in one designated run when ``run`` is given."""
    rows = ledger.filter(F.coalesce(flag, F.lit(False)) & F.col(block).isNotNull())
    if run is not None:
        rows = rows.filter(run)
    return rows.select(block).distinct()


def flag_or_threshold(rows: DataFrame, flag: str, threshold: float) -> Column:
    """The flag column where the table has it, else a large absolute return."""
    move = F.col("abs_mid_ret") > threshold
    return F.coalesce(F.col(flag), move) if flag in rows.columns else move


def mark_window(rows: DataFrame, keys_in: DataFrame, block: str = "book_event_id") -> DataFrame:
    """``in_window`` for every row."""
    return rows.join(keys_in.withColumn("_in", F.lit(True)), block, "left").withColumn(
        "in_window", F.coalesce("_in", F.lit(False))
    ).drop("_in")


def split_pnl(ledger: DataFrame, keys_in: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Sums of increments of every pnl part inside and outside the window."""
    rows = increments(ledger.select(*keys, *BLOCK, *DELTA_COLUMNS), DELTA_COLUMNS, keys, skip_null=True)
    return mark_window(rows, keys_in).groupBy(*keys, "in_window").agg(
        *[F.coalesce(F.sum(f"delta_{c}"), F.lit(0.0)).alias(c) for c in DELTA_COLUMNS]
    )


def split_fills(fills: DataFrame, keys_in: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return mark_window(fills, keys_in).groupBy(*keys, "in_window").agg(
        F.count(F.lit(1)).alias("fills"), F.sum(notional()).alias("notional")
    )


def split_inventory(ledger: DataFrame, keys_in: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return inventory_stats(mark_window(ledger, keys_in), [*keys, "in_window"], {"p95": 0.95})


def split_exposure(ledger: DataFrame, keys_in: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Previous position against the price change: sum of products, means, correlation."""
    narrow = ledger.select(*keys, *BLOCK, "position", "mark_price")
    near = ordered.over(narrow, keys, BLOCK, _p=ordered.previous(F.struct("position", "mark_price")))
    rows = near.filter(F.col("_p").isNotNull()).withColumns(
        {"_pos": F.coalesce("_p.position", F.lit(0.0)), "_d": F.col("mark_price") - F.col("_p.mark_price")}
    ).filter(F.col("_d").isNotNull())
    return mark_window(rows, keys_in).groupBy(*keys, "in_window").agg(
        F.sum(F.col("_pos") * F.col("_d")).alias("pos_ret"),
        F.avg("_pos").alias("mean_pos_prev"),
        F.avg("_d").alias("mean_dprice"),
        guarded_corr(F.col("_pos"), F.col("_d")).alias("corr_pos_prev_dprice"),
    )


def split_flag(ledger: DataFrame, keys_in: DataFrame, flag: str, keys: Sequence[str] = RUN) -> DataFrame:
    on = F.coalesce(F.col(flag), F.lit(False))
    return mark_window(ledger, keys_in).groupBy(*keys, "in_window").agg(
        F.count_if(on).alias("n_true"), F.count(F.lit(1)).alias("n"), F.avg(on.cast("double")).alias("rate")
    )


def split_markout(
    ledger: DataFrame, fills: DataFrame, keys_in: DataFrame, horizon_ms: int, keys: Sequence[str] = RUN
) -> DataFrame:
    """Mean markout and realized spread of fills inside and outside the window, against the ledger's marks."""
    rows = fill_outcomes(fills, mid_series(ledger, "mark_price", keys), [horizon_ms], keys)
    rows = rows.filter(F.col("markout").isNotNull())
    return mark_window(rows, keys_in).groupBy(*keys, "in_window").agg(
        F.avg("markout").alias("markout"), F.avg("realized_spread").alias("realized_spread")
    )


def unwind_outside_window(
    ledger: DataFrame, fills: DataFrame, keys_in: DataFrame, keys: Sequence[str] = RUN, block: str = "book_event_id",
    flag: str = "post_pull_unwind_active",
) -> DataFrame:
    """Fills, notional and mean absolute position of blocks in unwind but outside the pull window."""
    active = ledger.filter(F.col(flag)).join(keys_in, block, "left_anti")
    held = active.groupBy(*keys).agg(F.avg(F.abs("position")).alias("avg_abs_pos"))
    blocks = active.select(*keys, block).distinct()
    deals = fills.join(blocks, [*keys, block], "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fills"), F.sum(notional()).alias("notional")
    )
    return held.join(deals, list(keys), "full").fillna({"fills": 0, "notional": 0.0})


def flow_markout(
    outcomes: DataFrame, features: DataFrame, feature: str, q: float | None = None, keys: Sequence[str] = RUN,
    block: str = "book_event_id", threshold: float | None = None,
) -> DataFrame:
    """Markout of fills by side and by sign of a feature beyond ``threshold``, or beyond a quantile ``q`` of its absolute value.

    The feature is looked up at the fill's block (the last of duplicate rows). The quantile is taken per run over what can be
    looked up, so each block counts once.
    """
    if (q is None) == (threshold is None):
        raise ValueError("give either q or threshold")
    known = features.filter(val.finite(F.col(feature))).select(
        *keys, block, "block_ts_ms", F.col(feature).cast("double").alias("_x")
    )
    lookup = known.groupBy(*keys, block).agg(F.max_by("_x", "block_ts_ms").alias("_x"))
    if threshold is None:
        lookup = scratch.keep(lookup, "features")  # read by the quantile and by the join
    rows = outcomes.filter(F.col("markout").isNotNull()).join(lookup, [*keys, block])
    if threshold is not None:
        rows = rows.withColumn("threshold", F.lit(float(threshold)))
    else:
        rows = rows.join(quantiles.quantile_columns(lookup, keys, F.abs("_x"), {"threshold": q}), list(keys))
    sign = F.when(F.col("_x") > F.col("threshold"), F.lit("pos")).when(F.col("_x") < -F.col("threshold"), F.lit("neg"))
    side = F.when(F.col("side") == "buy", F.lit("bid")).otherwise(F.lit("ask"))
    groups = rows.withColumns({"quote_side": side, "flow": sign, "_w": notional()}).filter(F.col("flow").isNotNull())
    groups = scratch.keep(groups.select(*keys, "quote_side", "flow", "markout", "_w", "threshold"), "flow")
    place = [*keys, "quote_side", "flow"]
    points = quantiles.quantile_columns(groups, place, "markout", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    sums = groups.groupBy(*place).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("markout").alias("mean"),
        F.sum("_w").alias("notional"),
        F.sum(F.col("markout") * F.col("_w")).alias("markout_notional"),
        F.max("threshold").alias("threshold"),
    )
    return sums.withColumn("weighted_mean", F.try_divide(F.col("markout_notional"), F.col("notional"))).join(points, place)


def _last_window(length_ms: int, step_ms: int, count: int | None) -> Column:
    """Number of the last window that ends within the span of the key; -1 or less if none does."""
    last = F.floor((F.col("_end") - F.col("_start") - F.lit(length_ms)) / F.lit(step_ms)).cast("bigint")
    return last if count is None else F.least(last, F.lit(count - 1).cast("bigint"))


def overlapping_windows(
    rows: DataFrame, length_ms: int, step_ms: int, keys: Sequence[str] = (), count: int | None = None
) -> DataFrame:
    """Window dimension: ``[start + i * step, + length)`` for each key, while it ends within the data (the first ``count``, if given)."""
    span = rows.groupBy(*keys).agg(F.min("block_ts_ms").alias("_start"), F.max("block_ts_ms").alias("_end"))
    last = _last_window(length_ms, step_ms, count)
    listed = span.filter(last >= 0).withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("_start").cast("bigint") + F.col("window_no") * F.lit(step_ms).cast("bigint")
    return listed.select(
        *keys, F.col("window_no").cast("int").alias("window_no"), start.alias("start_ms"), (start + F.lit(length_ms).cast("bigint")).alias("end_ms")
    ).withColumn("window_id", val.time_tag(F.col("start_ms")))


def assign_windows(
    rows: DataFrame, length_ms: int, step_ms: int, keys: Sequence[str] = (), at: str = "block_ts_ms",
    span_of: DataFrame | None = None, count: int | None = None,
) -> DataFrame:
    """Each row once per window that covers it. The covering windows are computed, not joined."""
    base = span_of if span_of is not None else rows
    span = base.groupBy(*keys).agg(F.min("block_ts_ms").alias("_start"), F.max("block_ts_ms").alias("_end"))
    joined = rows.join(span, list(keys)) if keys else rows.join(F.broadcast(span))  # one row without keys
    off = F.col(at) - F.col("_start")
    first = F.greatest(F.floor((off - length_ms) / F.lit(step_ms)) + 1, F.lit(0))
    last = F.least(F.floor(off / F.lit(step_ms)), _last_window(length_ms, step_ms, count))
    covered = joined.withColumn(
        "window_no", F.explode(F.when((off >= 0) & (first <= last), F.sequence(first, last)))
    )
    start = F.col("_start") + F.col("window_no") * step_ms
    return covered.withColumns(
        {"window_no": F.col("window_no").cast("int"), "start_ms": start.cast("bigint"), "window_id": val.time_tag(start)}
    ).drop("_start", "_end")


def to_long(metrics: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, metric, value) from one row per run."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return metrics.select(*keys, F.inline(pairs))


def baseline_delta(long: DataFrame, baseline: str, run: str = "run_id") -> DataFrame:
    """Value and difference from the baseline run, per run and metric."""
    base = long.filter(F.col(run) == baseline).select("metric", F.col("value").alias("_base"))
    return long.join(base, "metric", "left").withColumn("delta", F.col("value") - F.col("_base")).drop("_base")


def metric_table(long: DataFrame, metrics: Sequence[str], run: str = "run_id", value: str = "value") -> DataFrame:
    """Runs by chosen metrics."""
    return long.groupBy(run).pivot("metric", list(metrics)).agg(F.first(value))


def baseline_first(runs: DataFrame, baseline: str, run: str = "run_id") -> DataFrame:
    return runs.orderBy(F.col(run) != baseline, run)


def pair_windows(results: DataFrame, baseline: str, columns: Sequence[str], variant: str = "variant", window: str = "window_id") -> DataFrame:
    """Candidate results with the baseline's of the same window: ``{c}``, ``base_{c}``, ``delta_{c}``."""
    base = results.filter(F.col(variant) == baseline).select(window, *[F.col(c).alias(f"base_{c}") for c in columns])
    pairs = results.filter(F.col(variant) != baseline).join(base, window)
    return pairs.withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in columns})


def ab_summary(pairs: DataFrame, medians: Sequence[str], delta: str = "delta_pnl", variant: str = "variant") -> DataFrame:
    """Windows, median difference, wins and medians per candidate, with the verdict.

    Input has one row per (candidate, window): the built-in exact percentile is safe here.
    """
    d = F.col(delta)
    out = pairs.groupBy(variant).agg(
        F.count(d).alias("windows"),
        F.percentile(d, F.lit(0.5)).alias("median_delta"),
        F.count_if(d > 0).alias("wins"),
        *[F.percentile(F.col(c), F.lit(0.5)).alias(f"median_{c}") for c in medians],
    )
    rate = F.try_divide(F.col("wins").cast("double"), F.col("windows").cast("double"))
    passed = (F.col("median_delta") > 0) & (F.col("win_rate") >= MIN_WIN_RATE)
    return out.withColumn("win_rate", rate).withColumn("verdict", F.when(passed, F.lit("PASS")).otherwise(F.lit("FAIL")))


def fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content print of a table per key: rows, sum and xor of row hashes, and a short hash of those.

    A row's hash is the first 60 bits of the SHA-256 of its values as text, joined by ``|``, null as ``~``; any engine can compute it.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")
    )
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("rows", "hash_sum", "hash_xor")])
    return out.withColumn("sha256", F.sha2(text, 256)).withColumn("hash8", F.substring("sha256", 1, 8))


def same_as_baseline(prints: DataFrame, baseline: str, run: str = "run_id") -> DataFrame:
    """Compares each print with the baseline run's print of the same other keys (null where the baseline has none)."""
    other = [c for c in prints.columns if c not in (run, "rows", "hash_sum", "hash_xor", "sha256", "hash8")]
    base = prints.filter(F.col(run) == baseline).select(*other, F.col("sha256").alias("_base"))
    joined = prints.join(base, other, "left") if other else prints.join(F.broadcast(base), how="left")  # one row without other keys
    return joined.withColumn("same_as_baseline", F.col("sha256") == F.col("_base")).drop("_base")
