"""Forward targets, chronological splits, edge screen, flow checks and risk windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideblock import scratch
from tideblock.functions import book as bk
from tideblock.functions.values import finite
from tideblock.operators import ordered, quantiles
from tideblock.operators.asof import asof
from tideblock.operators.blocks import BLOCK, EXACT, KEYS

LAG_BUCKET = 1_000_000


def targets(rows: DataFrame, horizons_s: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Long form: one row per (row, horizon) with ``y_markout`` and ``y_ret``.

    The future mid is that of the first row at or after ``t + h``; null when that row has none.
    """
    asked = rows.withColumn("horizon_s", F.explode(F.array(*[F.lit(int(h)).cast("bigint") for h in horizons_s])))
    hit = asof(
        asked, rows, keys, at=F.col("block_ts_ms") + F.col("horizon_s") * 1000, quote_at="block_ts_ms",
        payload=["mid"], ties=BLOCK[1:], direction="forward", into="_future",
    )
    change = F.col("_future.mid") - F.col("mid")
    return hit.withColumns({"y_markout": change, "y_ret": F.try_divide(change, F.col("mid"))}).drop("_future")


def wide_targets(rows: DataFrame, horizons_s: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """``y_markout_{h}s`` and ``y_ret_{h}s`` columns on every row."""
    long = targets(rows.select(*keys, *BLOCK, "mid"), horizons_s, keys)
    wide = long.groupBy(*keys, *BLOCK).agg(
        *[
            F.max(F.when(F.col("horizon_s") == h, F.col(c))).alias(f"{c}_{h}s")
            for h in horizons_s
            for c in ("y_markout", "y_ret")
        ]
    )
    return rows.join(wide, [*keys, *BLOCK], "left")


def split_bounds(rows: DataFrame, keys: Sequence[str] = KEYS, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Start, end of train, end of valid and end of each key's time span."""
    span = rows.groupBy(*keys).agg(F.min("block_ts_ms").alias("start"), F.max("block_ts_ms").alias("end"))
    width = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    return span.withColumns(
        {
            "train_end": F.col("start") + F.floor(width * F.lit(train)),
            "valid_end": F.col("start") + F.floor(width * F.lit(train + valid)),
        }
    )


def split_table(bounds: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per split with its start and end."""
    part = lambda name, a, b: F.struct(F.lit(name).alias("split"), F.col(a).alias("start_ms"), F.col(b).alias("end_ms"))
    parts = F.array(part("train", "start", "train_end"), part("valid", "train_end", "valid_end"), part("test", "valid_end", "end"))
    return bounds.select(*keys, F.inline(parts))


def assign_split(rows: DataFrame, keys: Sequence[str] = KEYS, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    bounds = split_bounds(rows, keys, train, valid).select(*keys, "train_end", "valid_end")
    t = F.col("block_ts_ms")
    label = (
        F.when(t.isNull(), F.lit("unknown"))
        .when(t < F.col("train_end"), F.lit("train"))
        .when(t < F.col("valid_end"), F.lit("valid"))
        .otherwise(F.lit("test"))
    )
    return rows.join(bounds, list(keys), "left").withColumn("split", label).drop("train_end", "valid_end")


def numeric_features(df: DataFrame, exclude: Sequence[str] = (), include_targets: bool = False) -> list[str]:
    """Numeric columns by name, without the target, keys, time and (by default) other targets."""
    skip = {"split", "block_ts_ms", "book_event_id", *exclude}
    names = [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    return sorted(n for n in names if include_targets or not n.startswith("y_"))


def feature_rows(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str]) -> DataFrame:
    """Long form (keep, feature, x, y) of finite pairs."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in features])
    long = df.select(*keep, F.col(target).cast("double").alias("y"), F.inline(pairs))
    return long.filter(finite(F.col("x")) & finite(F.col("y")))


def z_products(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``z``, the product of standardised x and y (population deviation, 0 read as 1)."""
    moments = long.groupBy(*keys).agg(
        F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.stddev_pop("x").alias("_sx"), F.stddev_pop("y").alias("_sy"),
    )
    unit = lambda c: F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.col(c))
    z = ((F.col("x") - F.col("_mx")) / unit("_sx")) * ((F.col("y") - F.col("_my")) / unit("_sy"))
    return long.join(moments, list(keys)).withColumn("z", z).drop("_mx", "_my", "_sx", "_sy")


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int) -> DataFrame:
    """Adds ``lag_1 .. lag_n`` of ``value``.

    Rows are numbered by a chunked scan; buckets of row numbers are then exact, and the last ``lags`` rows of a
    bucket are repeated in the next one.
    """
    numbered = ordered.over(rows, keys, order, _rn=ordered.row_count())
    own = F.floor((F.col("_rn") - 1) / F.lit(LAG_BUCKET)).cast("bigint")
    tail = (F.col("_rn") - 1) % LAG_BUCKET >= LAG_BUCKET - lags
    spread = numbered.withColumn("_own", own).withColumn(
        "_b", F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    w = Window.partitionBy(*keys, "_b").orderBy("_rn")
    out = spread.withColumns({f"lag_{i}": F.lag(value, i).over(w) for i in range(1, lags + 1)})
    return out.filter(F.col("_b") == F.col("_own")).drop("_b", "_own", "_rn")


def newey_west(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lag: int = 5) -> DataFrame:
    """``n``, ``mean`` and the Bartlett-weighted standard error ``se`` of the mean."""
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    centred = rows.join(means.select(*keys, "mean"), list(keys)).withColumn("_d", F.col(value) - F.col("mean"))
    shifted = lagged(centred.select(*keys, *order, "_d"), keys, order, "_d", lag)
    sums = shifted.groupBy(*keys).agg(
        F.sum(F.col("_d") * F.col("_d")).alias("_c0"),
        *[F.coalesce(F.sum(F.col("_d") * F.col(f"lag_{i}")), F.lit(0.0)).alias(f"_c{i}") for i in range(1, lag + 1)],
    )
    out = sums.join(means, list(keys))
    n = F.col("n")
    total = F.col("_c0") / n
    for i in range(1, lag + 1):
        # A series shorter than the lags keeps the full-lag weights and stops at n - 1.
        total = total + F.lit(2.0 * (1.0 - i / (lag + 1.0))) * F.when(F.lit(i) <= n - 1, F.col(f"_c{i}") / n).otherwise(0.0)
    se = F.sqrt(F.greatest(total, F.lit(0.0)) / n)
    return out.select(*keys, "n", "mean", F.when(n >= 2, se).alias("se"))


def ic(long: DataFrame, keys: Sequence[str], order: Sequence[str], lag: int = 5) -> DataFrame:
    """Information coefficient with a 95 % interval per key; null below two rows."""
    stats = newey_west(z_products(long, keys), keys, order, "z", lag)
    enough = F.col("n") >= 2
    return stats.select(
        *keys, "n",
        F.when(enough, F.col("mean")).alias("ic"),
        F.when(enough, F.col("mean") - 1.96 * F.col("se")).alias("ci_low"),
        F.when(enough, F.col("mean") + 1.96 * F.col("se")).alias("ci_high"),
    )


def quantile_effect(long: DataFrame, keys: Sequence[str], q: float = 0.2) -> DataFrame:
    """Mean y in the low, middle and high part of x, and the high-minus-low effect in bps.

    Sums of y, as decimals, run along the order of x, so the three parts are differences at the two quantiles.
    """
    index = quantiles.Index(long, keys, "x", sums={"y": F.col("y").cast(EXACT), "m": F.col("y").isNotNull().cast("bigint")})
    edge = lambda p, c: F.max(F.when(F.col("p") == p, F.col(c)))
    names = ("y", "m")
    at = index.at([q, 1 - q]).groupBy(*keys).agg(
        *[edge(q, f"upto_{n}").alias(f"_low_{n}") for n in names], *[edge(1 - q, f"below_{n}").alias(f"_under_{n}") for n in names]
    )
    rows = at.join(index.totals(), list(keys))
    # Where the two quantiles meet on one value, its rows are low and high, and no row is between.
    between = {n: F.col(f"_under_{n}") - F.col(f"_low_{n}") for n in names}
    some = lambda total, count: F.when(count > 0, total.cast("double") / count)
    out = rows.select(
        *keys,
        some(F.col("_low_y"), F.col("_low_m")).alias("mean_low"),
        some(between["y"], between["m"]).alias("mean_mid"),
        some(F.col("total_y") - F.col("_under_y"), F.col("total_m") - F.col("_under_m")).alias("mean_high"),
    )
    return out.withColumn("effect_bps", (F.col("mean_high") - F.col("mean_low")) * 10_000)


def edge_screen(
    dataset: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = (), order: Sequence[str] = BLOCK,
    threshold: float = 0.01, lag: int = 5, q: float = 0.2,
) -> DataFrame:
    """IC, interval, quantile effect and verdict of every feature on the train rows, or on all rows without any."""
    has_train = dataset.groupBy(*keys).agg(F.bool_or(F.col("split") == "train").alias("_has"))
    joined = dataset.join(has_train, list(keys)) if keys else dataset.join(F.broadcast(has_train))
    rows = joined.filter(~F.coalesce(F.col("_has"), F.lit(False)) | (F.col("split") == "train"))
    place = [*keys, "feature"]
    # Read by every statistic below, so written once, in its narrow wide form.
    rows = scratch.keep(rows.select(*keys, *order, target, *features), "screen")
    long = feature_rows(rows, features, target, [*keys, *order])
    scores = ic(long, place, order, lag)
    effects = quantile_effect(long, place, q).select(*place, "effect_bps")
    return scores.join(effects, place, "left").withColumn(
        "keep", F.coalesce(F.abs("ic") >= threshold, F.lit(False))
    )


def cumulative_ic(long: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running mean of the z products."""
    run = ordered.over(
        z_products(long, keys), keys, order, _s=ordered.running_sum(F.col("z")), _n=ordered.row_count()
    )
    return run.withColumn("cum_ic", F.col("_s") / F.col("_n")).drop("_s", "_n")


def guarded_corr(x: Column, y: Column) -> Column:
    """Correlation; null for constant input or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.when(F.count_if(both) >= 2, F.try_divide(F.covar_pop(px, py), spread))


def flow_sign(rows: DataFrame, keys: Sequence[str] = KEYS, flow: str = "signed_volume", order: Sequence[str] = BLOCK) -> DataFrame:
    """Mean present and next return by sign of the flow, and their correlations with it."""
    narrow = rows.select(*keys, *order, "mid", flow)
    near = ordered.over(narrow, keys, order, _p=ordered.previous(F.col("mid")), _n=ordered.following(F.col("mid")))
    sv = F.col(flow)
    data = near.withColumns(
        {"_now": bk.simple_return(F.col("mid"), F.col("_p")), "_fwd": bk.simple_return(F.col("_n"), F.col("mid"))}
    )
    mean = lambda c, test: F.avg(F.when(test, F.col(c)))
    enough = lambda c: F.count_if(F.col(c).isNotNull() & sv.isNotNull()) >= 3
    return data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sv > 0).alias("n_pos"),
        F.count_if(sv < 0).alias("n_neg"),
        mean("_now", sv > 0).alias("ret_now_pos"),
        mean("_now", sv < 0).alias("ret_now_neg"),
        mean("_fwd", sv > 0).alias("ret_next_pos"),
        mean("_fwd", sv < 0).alias("ret_next_neg"),
        F.when(enough("_now"), guarded_corr(sv, F.col("_now"))).alias("corr_now"),
        F.when(enough("_fwd"), guarded_corr(sv, F.col("_fwd"))).alias("corr_next"),
    )


def risk_label(rows: DataFrame, keys: Sequence[str], q: float, delta: str = "pnl_delta") -> DataFrame:
    """``risk`` marks increments at or below their own q-quantile."""
    rows = scratch.keep(rows, "risk")
    cut = quantiles.quantile_columns(rows, keys, delta, {"_cut": q})
    return rows.join(cut, list(keys), "left").withColumn(
        "risk", F.coalesce(F.col(delta) <= F.col("_cut"), F.lit(False))
    ).drop("_cut")


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return {"precision": precision, "recall": recall, "f1": f1}


def threshold_windows(long: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Every (quantile threshold, direction) of a feature as a risk window.

    ``long`` has (keys, x, risk, delta). Values are put in order once, with running sums of what the scores need; each quantile finds the sums
    below and up to itself. The number of thresholds does not multiply the rows.
    """
    sums = {"r": F.col("risk").cast("bigint"), "dn": F.col("delta").isNotNull().cast("bigint"), "ds": F.col("delta").cast(EXACT)}
    names = ["n", *sums]
    index = quantiles.Index(long, keys, "x", sums=sums)
    total = index.totals().withColumnsRenamed({f"total_{n}": f"_t{n}" for n in names})
    placed = index.at(points).withColumnRenamed("q", "threshold")
    both = F.array(
        F.struct(F.lit("gt").alias("mode"), *[(F.col(f"_t{n}") - F.col(f"below_{n}")).alias(n) for n in names]),
        F.struct(F.lit("lt").alias("mode"), *[F.col(f"upto_{n}").alias(n) for n in names]),
    )
    joined = placed.join(total, list(keys))
    rows = joined.select(*keys, "p", "threshold", *[f"_t{n}" for n in names], F.inline(both))
    tp, fp, fn = F.col("r"), F.col("n") - F.col("r"), F.col("_tr") - F.col("r")
    return rows.withColumns(
        {
            "window_rate": F.col("n") / F.col("_tn"),
            "mean_delta_in": F.try_divide(F.col("ds").cast("double"), F.col("dn")),
            "mean_delta_out": F.try_divide((F.col("_tds") - F.col("ds")).cast("double"), F.col("_tdn") - F.col("dn")),
            **_scores(tp, fp, fn),
        }
    ).select(*keys, "p", "mode", "threshold", "window_rate", "precision", "recall", "f1", "mean_delta_in", "mean_delta_out")


def best_window(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The window with the highest F1; ties go to the lower quantile, then to ``gt``."""
    rank = F.struct(F.col("f1"), -F.col("p"), (F.col("mode") == "gt").cast("int"))
    names = ["p", "mode", "threshold", "window_rate", "precision", "recall", "f1", "mean_delta_in", "mean_delta_out"]
    return windows.groupBy(*keys).agg(F.max_by(F.struct(*names), rank).alias("_b")).select(*keys, "_b.*")


def fixed_rate_windows(long: DataFrame, keys: Sequence[str], rates: Sequence[float]) -> DataFrame:
    """Windows holding the top or bottom ``rate`` of the feature; rows without an increment are left out."""
    points = sorted({round(p, 12) for r in rates for p in (1.0 - r, r)})
    windows = threshold_windows(long.filter(F.col("delta").isNotNull()), keys, points)
    rate = F.when(F.col("mode") == "gt", F.round(1.0 - F.col("p"), 12)).otherwise(F.round("p", 12))
    wanted = windows.withColumn("target_rate", rate)
    return wanted.filter(F.col("target_rate").isin([round(r, 12) for r in rates])).drop("p")
