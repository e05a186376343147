"""KPIs of runs from their five logs: market state, decisions, orders, fills and events, all keyed by ``run_id``.

``seq`` numbers the lines of a log and settles ties of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import values as val
from tideblock.operators import ordered, quantiles
from tideblock.operators.asof import Ask, Source, asof, lookups

RUN = ["run_id"]
ORDER = ["ts_ms", "seq"]
# Markout horizon used for cohorts, minimum span of action rates in minutes.
COHORT_HORIZON_S = 30
MIN_SPAN_MINUTES = 1e-6
# Cohort flags of an order and the names they are reported under.
COHORTS = {
    "backoff": "reject_backoff_active",
    "risk_escape": "risk_escape_applied",
    "size_down": "risk_size_down_applied",
    "lag_quiet": "risk_escape_global_lag_quiet_trigger",
}
SENT_ACTIONS = ["new", "replace"]
# Where a mid is from, the best source first.
MID_SOURCES = ["best_bid_ask", "market_state_mid", "mark_px"]
# Reasons in parentheses of a replace guard.
REPLACE_GUARD_REASONS = ["recent_cancel_all", "order_id_missing_stage2", "dead_order_id", "cancel_inflight"]
FALLBACK_SKIPS = ["cooldown_skip", "rate_limit_cooldown_skip", "run_cap_skip"]


def _on(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _bucket() -> Column:
    return F.coalesce(F.nullif(F.col("risk_escape_bucket"), F.lit("")), F.lit("none"))


def _side(name: str = "side") -> Column:
    word = F.lower(F.col(name))
    return F.when(word.isin("buy", "sell"), word).otherwise(F.lit("-"))


def is_sent() -> Column:
    return F.coalesce(F.col("action").isin(SENT_ACTIONS), F.lit(False))


def market_mids(market: DataFrame) -> DataFrame:
    """Mid with its source: positive best prices, else the logged mid, else the mark price."""
    top = (F.col("best_bid") > 0) & (F.col("best_ask") > 0)
    best, logged, mark = [F.lit(n) for n in MID_SOURCES]
    source = F.when(top, best).when(F.col("mid").isNotNull(), logged).when(F.col("mark_px").isNotNull(), mark)
    value = F.when(top, (F.col("best_bid") + F.col("best_ask")) / 2).otherwise(F.coalesce("mid", "mark_px"))
    return market.filter(F.col("ts_ms").isNotNull()).withColumns({"mid_source": source, "mid": value})


def scoped_fills(fills: DataFrame, market: DataFrame) -> DataFrame:
    """Fills with a price and a positive size; ``out_of_run`` when outside the run's market log."""
    span = market.filter(F.col("ts_ms").isNotNull()).groupBy(*RUN).agg(
        F.min("ts_ms").alias("_lo"), F.max("ts_ms").alias("_hi")
    )
    # Written, so that its size is known before the join and the fills aren't shuffled for it.
    span = scratch.keep(span, "span")
    usable = fills.filter(F.col("px").isNotNull() & (F.col("sz") > 0))
    timed = usable.withColumn("ts_ms", val.epoch_ms(F.col("time"), F.col("ts_ms")))
    outside = (F.col("ts_ms") < F.col("_lo")) | (F.col("ts_ms") > F.col("_hi"))
    return timed.join(span, RUN, "left").withColumn("out_of_run", F.coalesce(outside, F.lit(False))).drop("_lo", "_hi")


def _market_columns(hit: DataFrame) -> DataFrame:
    mid = F.nullif(F.col("_m.mid"), F.lit(0.0))
    source = {"mid_source": F.when(mid.isNotNull(), F.col("_m.mid_source"))} if "mid_source" in hit.schema["_m"].dataType.names else {}
    return hit.withColumns(
        {"mid": mid, "joined": mid.isNotNull(), **source, "join_dt_ms": F.when(mid.isNotNull(), F.col("ts_ms") - F.col("_m.at_ms"))}
    ).drop("_m")


def fill_market(fills: DataFrame, mids: DataFrame) -> DataFrame:
    """Last market state at or before each fill; ``joined`` needs a non-zero mid."""
    return _market_columns(asof(fills, mids, RUN, at="ts_ms", quote_at="ts_ms", payload=["mid", "mid_source"], ties=["seq"], into="_m"))


def fill_edges(fills: DataFrame) -> DataFrame:
    """Edge against mid, fee and net, in bps; null for fills without mid or side."""
    side = val.normalize_side(F.col("side"))
    gain = F.when(side == "buy", F.col("mid") - F.col("px")).when(side == "sell", F.col("px") - F.col("mid"))
    edge = F.try_divide(gain, F.col("mid")) * 1e4
    amount = F.col("px") * F.col("sz")
    fee = F.coalesce(F.col("fee"), F.lit(0.0))
    fee_bps = F.when(amount > 0, fee / amount * 1e4).otherwise(F.lit(0.0))
    return fills.withColumns(
        {
            "side_key": side,
            "notional": amount,
            "fee": fee,
            "edge_bps": edge,
            "fee_bps": F.when(edge.isNotNull(), fee_bps),
            "net_bps": edge - fee_bps,
        }
    )


ORDER_FIELDS = ["effective_spread_bps", "risk_escape_bucket", *COHORTS.values()]


def _sent_orders(orders: DataFrame) -> DataFrame:
    sent = orders.filter(is_sent() & F.col("ts_ms").isNotNull()).withColumn("_cid", val.client_id(F.col("client_oid")))
    return sent.filter(F.col("_cid").isNotNull()).withColumn("risk_escape_bucket", _bucket())


def _order_columns(hit: DataFrame) -> DataFrame:
    state = (
        F.when(F.col("_cid").isNull(), F.lit("missing"))
        .when(F.col("ord").isNull(), F.lit("unmatched"))
        .otherwise(F.lit("matched"))
    )
    return hit.withColumns({"order_match": state, "order_dt_ms": F.col("ts_ms") - F.col("ord.at_ms")}).drop("_cid")


def fill_orders(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Latest new or replace order of the same client id at or before the fill, as struct ``ord``."""
    asked = fills.withColumn("_cid", val.client_id(F.col("cloid")))
    return _order_columns(asof(asked, _sent_orders(orders), [*RUN, "_cid"], at="ts_ms", quote_at="ts_ms", payload=ORDER_FIELDS, ties=["seq"], into="ord"))


def _boosts(decisions: DataFrame) -> DataFrame:
    known = [F.col(c) for c in ("boost_active", "boost_triggered") if c in decisions.columns]
    return decisions.withColumn("boost_active", F.coalesce(*known, F.lit(False)))


def _decision_columns(hit: DataFrame) -> DataFrame:
    key = F.when(F.col("_d.boost_active"), F.lit("boost")).when(F.col("_d").isNotNull(), F.lit("base"))
    return hit.withColumn("boost_key", F.coalesce(key, F.lit("unknown"))).drop("_d")


def fill_decisions(fills: DataFrame, decisions: DataFrame) -> DataFrame:
    """Boost state of the last decision at or before the fill; the last line of an instant wins.

    ``boost_active``, else ``boost_triggered`` where the log has it, else not boosted.
    """
    return _decision_columns(asof(fills, _boosts(decisions), RUN, at="ts_ms", quote_at="ts_ms", payload=["boost_active"], ties=["seq"], into="_d"))


def _markout_bps(future: Column) -> Column:
    future = F.nullif(future, F.lit(0.0))
    gain = F.when(F.col("side_key") == "buy", future - F.col("px")).otherwise(F.col("px") - future)
    return F.try_divide(gain, future) * 1e4


def fill_markouts(fills: DataFrame, mids: DataFrame, horizons_s: Sequence[int]) -> DataFrame:
    """Long form: ``markout_bps`` of the fill price against the first mid at or after each horizon."""
    asked = fills.withColumn("horizon_s", F.explode(F.array(*[F.lit(int(h)).cast("bigint") for h in horizons_s])))
    hit = asof(
        asked, mids, RUN, at=F.col("ts_ms") + F.col("horizon_s") * 1000, quote_at="ts_ms", payload=["mid"], ties=["seq"],
        direction="forward", into="_f",
    )
    return hit.withColumn("markout_bps", _markout_bps(F.col("_f.mid"))).drop("_f")


def enrich_fills(
    fills: DataFrame, market: DataFrame, orders: DataFrame | None = None, decisions: DataFrame | None = None, horizons_s: Sequence[int] = (),
    mid_source: bool = True,
) -> DataFrame:
    """Fills of the run with market, order and decision joins and their edges.

    Without ``orders`` or ``decisions`` the columns of that join are left out, and ``mid_source`` if not asked for. With ``horizons_s`` also
    ``markouts``, one (horizon_s, markout_bps) for each. All of these questions are answered in one pass. Of ``fills``, columns beyond
    time, side, px, sz and fee (cloid with ``orders``) are only carried along.
    """
    inside = scoped_fills(fills, market).filter(~F.col("out_of_run"))
    now, names = F.col("ts_ms"), F.array(*[F.lit(n) for n in MID_SOURCES])
    # The source goes by its number: fields of fixed width are looked up faster.
    mids = market_mids(market).withColumn("mid_source", F.array_position(names, F.col("mid_source")))
    asks, sources = {"_m": Ask("mid", now)}, {"mid": Source(mids, "ts_ms", ["mid", "mid_source"] if mid_source else ["mid"], ["seq"])}
    if orders is not None:
        inside = inside.withColumn("_cid", val.client_id(F.col("cloid")))
        asks["ord"], sources["order"] = Ask("order", now, extra=F.col("_cid")), Source(_sent_orders(orders), "ts_ms", ORDER_FIELDS, ["seq"], F.col("_cid"))
    if decisions is not None:
        asks["_d"], sources["decision"] = Ask("decision", now), Source(_boosts(decisions), "ts_ms", ["boost_active"], ["seq"])
    asks |= {f"_f{h}": Ask("mid", now + int(h) * 1000, "forward") for h in horizons_s}
    out = lookups(inside, RUN, asks, sources)
    if mid_source:
        out = out.withColumn("_m", F.col("_m").withField("mid_source", F.get(names, (F.col("_m.mid_source") - 1).cast("int"))))
    out = fill_edges(_market_columns(out))
    if orders is not None:
        out = _order_columns(out)
    if decisions is not None:
        out = _decision_columns(out)
    if horizons_s:
        late = [F.struct(F.lit(int(h)).cast("bigint").alias("horizon_s"), _markout_bps(F.col(f"_f{h}.mid")).alias("markout_bps")) for h in horizons_s]
        out = out.withColumn("markouts", F.array(*late)).drop(*[f"_f{h}" for h in horizons_s])
    return out


def markouts_of(enriched: DataFrame) -> DataFrame:
    """Long form of the markouts of :func:`enrich_fills`."""
    return enriched.select("*", F.inline("markouts")).drop("markouts")


def edge_stats(enriched: DataFrame) -> DataFrame:
    """Summary of edge, fee and net per run, long by measure."""
    return quantiles.summary(_measures(enriched, ["edge_bps", "fee_bps", "net_bps"]), [*RUN, "measure"], "x")


def edge_signs(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(*RUN).agg(
        F.count_if(F.col("edge_bps") < 0).alias("edge_negative"), F.count_if(F.col("edge_bps") == 0).alias("edge_zero")
    )


def _measures(df: DataFrame, names: Sequence[str], keep: Sequence[str] = RUN) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("x")) for n in names])
    return df.select(*keep, F.inline(pairs)).filter(F.col("x").isNotNull())


def markout_stats(markouts: DataFrame) -> DataFrame:
    return quantiles.summary(markouts.filter(F.col("edge_bps").isNotNull()), [*RUN, "horizon_s"], "markout_bps")


def maker_taker(scoped: DataFrame) -> DataFrame:
    """Counts, notional, fees and taker share of the fills inside the run; ``taker_guard_trip`` on any taker."""
    inside = scoped.filter(~F.col("out_of_run"))
    taker, amount, fee = _on("crossed"), F.col("px") * F.col("sz"), F.coalesce("fee", F.lit(0.0))
    pick = lambda test, c: F.coalesce(F.sum(F.when(test, c)), F.lit(0.0))
    sums = inside.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("fills"),
        F.count_if(~taker).alias("maker_fills"),
        F.count_if(taker).alias("taker_fills"),
        pick(~taker, amount).alias("maker_notional"),
        pick(taker, amount).alias("taker_notional"),
        pick(~taker, fee).alias("maker_fee"),
        pick(taker, fee).alias("taker_fee"),
        F.sum(amount).alias("notional"),
        F.sum(fee).alias("fee"),
    )
    bps = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 1e4)
    return sums.withColumns(
        {
            "fee_bps": bps("fee", "notional"),
            "maker_fee_bps": bps("maker_fee", "maker_notional"),
            "taker_fee_bps": bps("taker_fee", "taker_notional"),
            "taker_notional_share": F.when(F.col("notional") > 0, F.col("taker_notional") / F.col("notional")),
            "taker_guard_trip": F.col("taker_fills") > 0,
        }
    )


def fill_decomposition(enriched: DataFrame) -> DataFrame:
    """Summaries of edge, net and markouts by side, by boost, and by both, from one index of the measures."""
    measure = lambda name, x: F.struct(name.alias("measure"), x.cast("double").alias("x"))
    own = F.array(*[measure(F.lit(n), F.col(n)) for n in ("edge_bps", "net_bps")])
    if "markouts" in enriched.columns:
        named = lambda m: F.concat(F.lit("markout_"), m["horizon_s"].cast("string"), F.lit("s_bps"))
        own = F.concat(own, F.transform("markouts", lambda m: measure(named(m), m["markout_bps"])))
    long = enriched.filter(F.col("edge_bps").isNotNull()).select(*RUN, "side_key", "boost_key", F.inline(own))
    index = quantiles.Index(long, [*RUN, "measure"], "x", ["side_key", "boost_key"])
    groupings = {"side": ["side_key"], "boost": ["boost_key"], "boost_side": ["side_key", "boost_key"]}
    found = index.summary(*groupings.values())
    named = F.element_at(F.array(*[F.lit(n) for n in groupings]), F.col("grouping") + 1)
    shown = lambda c: F.when(F.col("grouping").isin([i for i, g in enumerate(groupings.values()) if c in g]), F.col(c)).otherwise(F.lit("all"))
    return found.withColumns({"side_group": shown("side_key"), "boost_group": shown("boost_key"), "grouping": named}).drop("side_key", "boost_key")


def net_by_spread(enriched: DataFrame) -> DataFrame:
    """Net summary by effective spread of the matched order, rounded half-even to 0.01."""
    rows = enriched.filter(F.col("net_bps").isNotNull() & F.col("ord.effective_spread_bps").isNotNull())
    shown = F.bround(F.col("ord.effective_spread_bps").cast("decimal(28,8)"), 2).cast("string")
    return quantiles.summary(rows.withColumn("spread_bucket", shown), [*RUN, "spread_bucket"], "net_bps")


def join_quality(scoped: DataFrame, mids: DataFrame) -> DataFrame:
    """Joined, missed and out-of-run fills, time to the joined state, and the mid source."""
    out = scoped.groupBy(*RUN).agg(F.count_if("out_of_run").alias("out_of_run"))
    hit = scratch.keep(fill_market(scoped.filter(~F.col("out_of_run")), mids), "joined")
    counts = hit.groupBy(*RUN).agg(
        F.count_if("joined").alias("joined"),
        F.count_if(~F.col("joined")).alias("missed"),
        F.min("mid_source").alias("_first"),
        F.max("mid_source").alias("_last"),
    )
    dt = quantiles.quantile_columns(hit, RUN, "join_dt_ms", {"dt_ms_p50": 0.5, "dt_ms_p95": 0.95})
    source = F.when(F.col("_first") == F.col("_last"), F.col("_first")).when(F.col("_first").isNotNull(), F.lit("mixed"))
    return (
        out.join(counts, RUN, "left").join(dt, RUN, "left").withColumn("mid_source", source).drop("_first", "_last")
        .fillna({"joined": 0, "missed": 0})
    )


def order_match_quality(enriched: DataFrame) -> DataFrame:
    rows = scratch.keep(enriched.filter(F.col("edge_bps").isNotNull()).select(*RUN, "order_match", "order_dt_ms"), "matches")
    counts = rows.groupBy(*RUN).agg(
        *[F.count_if(F.col("order_match") == s).alias(f"cloid_{s}") for s in ("missing", "unmatched", "matched")]
    )
    dt = quantiles.quantile_columns(rows, RUN, "order_dt_ms", {"dt_ms_p50": 0.5, "dt_ms_p95": 0.95})
    return counts.join(dt, RUN, "left")


def spread_filter_rates(market: DataFrame) -> DataFrame:
    """Share of states in which the spread filter was on (skip) and off (active), where it was logged."""
    flag = F.col("spread_filter_active")
    rate = F.avg(flag.cast("double"))
    return market.filter(F.col("ts_ms").isNotNull()).groupBy(*RUN).agg(
        F.count(flag).alias("logged"), rate.alias("skip_rate"), (1 - rate).alias("active_rate")
    )


def decision_kpis(decisions: DataFrame) -> DataFrame:
    """Ticks, boost rate, and decisions without any size split by cause."""
    none = (F.coalesce("raw_bid_sz", F.lit(0.0)) <= 0) & (F.coalesce("raw_ask_sz", F.lit(0.0)) <= 0)
    return decisions.filter(F.col("ts_ms").isNotNull()).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.avg(_on("boost_active").cast("double")).alias("boost_rate"),
        F.count_if(none).alias("noop"),
        F.avg(none.cast("double")).alias("noop_rate"),
        F.count_if(none & _on("halt_triggered")).alias("noop_halt"),
        F.count_if(none & _on("stop_triggered")).alias("noop_stop"),
        F.count_if(none & _on("spread_filter_active")).alias("noop_spread_filter"),
    )


def at_touch(decisions: DataFrame, market: DataFrame) -> DataFrame:
    """Share of quotes within half a tick of the best price of the last state; one decision per instant."""
    asked = decisions.groupBy(*RUN, "ts_ms").agg(
        F.max_by(F.struct("final_bid_px", "final_ask_px"), "seq").alias("_q")
    )
    hit = asof(asked, market, RUN, at="ts_ms", quote_at="ts_ms", payload=["best_bid", "best_ask"], ties=["seq"], into="_m")
    bid, ask = F.col("_m.best_bid"), F.col("_m.best_ask")
    tol = F.coalesce(val.price_tick(bid), val.price_tick(ask), F.lit(0.0)) * 0.5
    near = lambda quote, best: F.avg((F.abs(quote - best) <= tol).cast("double"))
    return hit.groupBy(*RUN).agg(
        F.count(F.col("_q.final_bid_px") - bid).alias("bid_quotes"),
        near(F.col("_q.final_bid_px"), bid).alias("at_touch_bid_rate"),
        F.count(F.col("_q.final_ask_px") - ask).alias("ask_quotes"),
        near(F.col("_q.final_ask_px"), ask).alias("at_touch_ask_rate"),
    )


def _cohort_rows(df: DataFrame, source: str, keep: Sequence[str]) -> DataFrame:
    """Each row once per cohort flag, with its state."""
    at = lambda c: F.col(f"{source}.{c}") if source else F.col(c)
    flags = F.array(
        *[
            F.struct(F.lit(n).alias("cohort"), F.coalesce(at(c), F.lit(False)).alias("active"))
            for n, c in COHORTS.items()
        ]
    )
    return df.select(*keep, F.inline(flags))


def cohort_rates(orders: DataFrame, enriched: DataFrame, markouts: DataFrame) -> DataFrame:
    """Orders sent, rejects, fills, their rates and summaries of net and markout for each flag on and off."""
    place = [*RUN, "cohort", "active"]
    sent = _cohort_rows(
        orders.withColumns({"_sent": is_sent(), "_rejected": val.is_post_only_reject(F.col("error"))}), "",
        [*RUN, "_sent", "_rejected"],
    ).groupBy(*place).agg(F.count_if("_sent").alias("sent"), F.count_if("_rejected").alias("rejects"))
    matched = enriched.filter((F.col("order_match") == "matched") & F.col("edge_bps").isNotNull())
    filled = _cohort_rows(matched, "ord", RUN).groupBy(*place).agg(F.count(F.lit(1)).alias("fills"))
    out = sent.join(filled, place, "full").fillna({"sent": 0, "rejects": 0, "fills": 0})
    stats = scratch.keep(cohort_stats(enriched, markouts), "cohorts")
    for measure in ("net_bps", "markout_bps"):
        part = stats.filter(F.col("measure") == measure).select(
            *place, *[F.col(c).alias(f"{measure}_{c}") for c in ("count", "mean", "median", "p10", "p90")]
        )
        out = out.join(part, place, "left")
    rate = lambda c: F.when(F.col("sent") > 0, F.col(c) / F.col("sent"))
    return out.withColumns({"reject_rate": rate("rejects"), "fill_rate": rate("fills")})


def _cohort_measures(enriched: DataFrame, markouts: DataFrame) -> DataFrame:
    """Net and markout of matched fills, long by measure, with the bucket and flags of the order."""
    ok = (F.col("order_match") == "matched") & F.col("edge_bps").isNotNull()
    of_order = [F.col("ord.risk_escape_bucket").alias("bucket"), *[F.coalesce(F.col(f"ord.{c}"), F.lit(False)).alias(c) for c in COHORTS.values()]]
    rows = lambda df, name: df.select(*RUN, *of_order, F.lit(name).alias("measure"), F.col(name).alias("x"))
    return rows(enriched.filter(ok), "net_bps").unionByName(rows(markouts.filter(ok & F.col("markout_bps").isNotNull()), "markout_bps"))


def _cohort_summary(enriched: DataFrame, markouts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries for each flag on and off. Flags are groupings of one index, so a fill is counted once and not once per flag."""
    flags = list(COHORTS.values())
    index = quantiles.Index(_cohort_measures(enriched, markouts), [*RUN, "measure"], "x", [*by, *flags])
    cohort = F.element_at(F.array(*[F.lit(n) for n in COHORTS]), F.col("grouping") + 1)
    found = index.summary(*[[*by, c] for c in flags]).withColumns({"cohort": cohort, "active": F.coalesce(*flags)})
    return found.select(*RUN, "cohort", "active", *by, "measure", "count", "mean", *quantiles.SUMMARY_POINTS)


def cohort_stats(enriched: DataFrame, markouts: DataFrame) -> DataFrame:
    return _cohort_summary(enriched, markouts)


def cohort_stats_by_bucket(enriched: DataFrame, markouts: DataFrame) -> DataFrame:
    return _cohort_summary(enriched, markouts, ["bucket"])


def escape_counts(orders: DataFrame) -> DataFrame:
    """Triggered and applied risk escapes of sent orders by side and bucket, and sent orders by mode."""
    rows = orders.filter(is_sent()).withColumns(
        {"side_key": _side(), "bucket": _bucket(), "mode": F.lower(F.coalesce("risk_escape_mode", F.lit("none")))}
    )
    return rows.groupBy(*RUN, "side_key", "bucket", "mode").agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(_on("risk_escape_triggered")).alias("triggered"),
        F.count_if(_on("risk_escape_applied")).alias("applied"),
        F.avg(F.when(_on("risk_escape_triggered"), F.col("risk_escape_delta_ticks"))).alias("triggered_delta_ticks_mean"),
        F.avg(F.when(_on("risk_escape_applied"), F.col("risk_escape_delta_ticks"))).alias("applied_delta_ticks_mean"),
    )


def reject_breakdown(orders: DataFrame) -> DataFrame:
    """Post-only rejects counted along each reported dimension; ``-`` marks a dimension summed over."""
    dims = ["reject_class", "side_key", "spread_ticks", "round_mode", "bucket", "applied", "size_down"]
    rejects = orders.filter(val.is_post_only_reject(F.col("error"))).withColumns(
        {
            "reject_class": F.when(_on("pre_send_marketable"), F.lit("class1")).otherwise(F.lit("class2")),
            "side_key": _side(),
            "spread_ticks": F.when(
                F.col("pre_send_spread_ticks").isNotNull(), F.format_string("%.1f", F.col("pre_send_spread_ticks"))
            ).otherwise(F.lit("none")),
            "round_mode": F.coalesce("pre_send_round_mode", F.lit("none")),
            "bucket": _bucket(),
            "applied": F.when(_on("risk_escape_applied"), F.lit("applied")).otherwise(F.lit("inactive")),
            "size_down": F.when(_on("risk_size_down_applied"), F.lit("applied")).otherwise(F.lit("inactive")),
            "_one_tick": val.one_tick_spread(F.col("pre_send_spread_ticks")),
        }
    )
    sets = [
        ["reject_class"],
        ["reject_class", "side_key"],
        ["spread_ticks"],
        ["side_key", "spread_ticks"],
        ["reject_class", "spread_ticks"],
        ["reject_class", "side_key", "spread_ticks"],
        ["round_mode"],
        ["reject_class", "round_mode"],
        ["bucket"],
        ["applied"],
        ["bucket", "applied"],
        ["size_down"],
        ["bucket", "size_down"],
    ]
    grouped = rejects.groupingSets([[*RUN, *s] for s in sets], *RUN, *dims).agg(
        F.grouping_id().alias("_id"), F.count(F.lit(1)).alias("rejects"), F.count_if("_one_tick").alias("one_tick")
    )
    shown = {d: F.coalesce(F.col(d), F.lit("-")) for d in dims}
    return grouped.withColumns(shown).select(*RUN, F.col("_id").cast("bigint").alias("grouping_set"), *dims, "rejects", "one_tick")


def cancel_funnel(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Latency cancels sent, succeeded, needed and skipped by side and bucket."""
    cancel = (F.col("action") == "cancel") & (F.lower("reason") == "risk_escape_cancel_and_skip")
    ok = F.coalesce(F.col("status"), F.lit("")) != "error"
    sent = orders.filter(cancel).select(
        *RUN, _side().alias("side_key"), _bucket().alias("bucket"), F.lit(1).alias("sent"), ok.cast("int").alias("success"),
    )
    asked = events.filter(event_name() == "risk_escape_cancel_and_skip").withColumn("_d", F.lower("decision"))
    decided = F.coalesce(F.col("_d").isin("skip_only", "cancel_enqueued"), F.lit(False))
    tried = asked.select(
        *RUN, _side().alias("side_key"), F.coalesce("bucket", F.lit("none")).alias("bucket"),
        (decided & _on("cancel_needed")).cast("int").alias("needed"),
        (decided & ~_on("cancel_needed")).cast("int").alias("not_needed"),
        F.coalesce((F.col("_d") == "skip_only").cast("int"), F.lit(0)).alias("skipped"),
    )
    names = ["sent", "success", "needed", "not_needed", "skipped"]
    both = sent.unionByName(tried, allowMissingColumns=True)
    return both.groupBy(*RUN, "side_key", "bucket").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n in names]
    )


def cancel_gate(funnel: DataFrame, orders: DataFrame, events: DataFrame) -> DataFrame:
    """Whether a cancel was required and sent, and the cancel-all fallbacks, per run."""
    gate = funnel.groupBy(*RUN).agg(F.sum("needed").alias("needed"), F.sum("sent").alias("sent")).withColumn(
        "gate_required", F.col("needed") > 0
    ).withColumn("gate_pass", ~F.col("gate_required") | (F.col("sent") > 0))
    fallback = (F.col("action") == "cancel_all") & (F.lower("reason") == "risk_escape_cancel_and_skip_fallback")
    tried = orders.filter(fallback).groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("fallback_sent"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")) != "error").alias("fallback_success"),
    )
    skipped = events.filter(
        (event_name() == "risk_escape_cancel_all_fallback") & F.lower("decision").isin(FALLBACK_SKIPS)
    ).groupBy(*RUN).agg(F.count(F.lit(1)).alias("fallback_skip"))
    return gate.join(tried, RUN, "left").join(skipped, RUN, "left").fillna(
        0, ["fallback_sent", "fallback_success", "fallback_skip"]
    )


def cancel_skip_reasons(events: DataFrame) -> DataFrame:
    rows = events.filter((event_name() == "risk_escape_cancel_and_skip") & (F.lower("decision") == "skip_only"))
    return rows.groupBy(*RUN, F.coalesce(F.nullif("skip_reason", F.lit("")), F.lit("unknown")).alias("skip_reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def event_name() -> Column:
    return F.coalesce(F.col("event"), F.col("type"), F.lit(""))


def event_counts(events: DataFrame) -> DataFrame:
    """Events by name, reason and side, with total cooldown milliseconds."""
    rows = events.filter(F.col("ts_ms").isNotNull())
    cooldown = F.when(F.col("cooldown_ms") >= 0, F.col("cooldown_ms").cast("bigint"))
    return rows.groupBy(
        *RUN, event_name().alias("event"), F.coalesce(F.nullif("reason", F.lit("")), F.lit("-")).alias("reason"), _side().alias("side_key")
    ).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(cooldown), F.lit(0)).alias("cooldown_ms"))


def event_kpis(events: DataFrame) -> DataFrame:
    """Replace guards by reason, order-id marks, backoff and resync counts per run."""
    rows = events.filter(F.col("ts_ms").isNotNull()).withColumns(
        {"_e": event_name(), "_r": F.lower(F.coalesce("reason", F.lit("")))}
    )
    is_ = lambda name: F.col("_e") == name
    guard = lambda r: is_("replace_guard") & F.col("_r").rlike(r"replace->(skip|new) \(" + r + r"\)")
    manual = F.col("_r") != "periodic"
    cooldown = F.when(is_("reject_backoff") & (F.col("cooldown_ms") >= 0), F.col("cooldown_ms").cast("bigint"))
    return rows.groupBy(*RUN).agg(
        *[F.count_if(guard(r)).alias(f"replace_skip_{r}") for r in REPLACE_GUARD_REASONS],
        *[
            F.count_if(is_(n)).alias(n)
            for n in ("dead_order_id_mark", "cancel_inflight_mark", "cancel_inflight_clear", "reject_backoff", "reject_backoff_clear")
        ],
        F.coalesce(F.sum(cooldown), F.lit(0)).alias("backoff_ms"),
        F.count_if(is_("open_orders_sync") & manual).alias("resync_ok"),
        F.count_if(is_("open_orders_error") & manual).alias("resync_fail"),
        F.count_if(is_("send_skip") & (F.col("_r") == "pre_send_stale_book")).alias("stale_book_skips"),
        F.count_if(is_("send_skip") & (F.col("_r") == "pre_send_guard_all_skipped")).alias("all_skipped"),
    )


def latency_stats(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Summaries of latencies and ages: all orders, stale-book skips, both, and class-2 rejects."""
    class2 = val.is_post_only_reject(F.col("error")) & ~_on("pre_send_marketable")
    rows = orders.withColumns(
        {
            "pre_send_recv_age_ms_all": F.col("pre_send_recv_age_ms"),
            "class2_send_latency_ms": F.when(class2, F.col("send_latency_ms")),
            "class2_recv_age_ms": F.when(class2, F.col("pre_send_recv_age_ms")),
        }
    )
    names = [
        "send_latency_ms", "pre_send_book_age_ms", "pre_send_recv_age_ms", "pre_send_recv_age_ms_all",
        "class2_send_latency_ms", "class2_recv_age_ms",
    ]
    stale = events.filter((event_name() == "send_skip") & (F.lower("reason") == "pre_send_stale_book"))
    skips = stale.withColumns(
        {"pre_send_recv_age_ms_skip": F.col("pre_send_recv_age_ms"), "pre_send_recv_age_ms_all": F.col("pre_send_recv_age_ms")}
    )
    long = _measures(rows, names).unionByName(
        _measures(skips, ["pre_send_recv_age_ms_skip", "pre_send_recv_age_ms_all"])
    )
    return quantiles.summary(long.filter(F.col("x") >= 0), [*RUN, "measure"], "x")


def marketable_sent(orders: DataFrame) -> DataFrame:
    return orders.groupBy(*RUN).agg(F.count_if(is_sent() & _on("pre_send_marketable")).alias("marketable_sent"))


def error_counts(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("error").isNotNull()).groupBy(
        *RUN, F.coalesce("action", F.lit("-")).alias("action"),
        F.coalesce(val.order_error_class(F.col("error")), F.lit("other")).alias("error_class"),
    ).agg(F.count(F.lit(1)).alias("n"))


def action_rates(orders: DataFrame) -> DataFrame:
    """Orders per action, and per minute of the run's order log."""
    span = orders.groupBy(*RUN).agg(
        F.greatest((F.max("ts_ms") - F.min("ts_ms")) / 60000.0, F.lit(MIN_SPAN_MINUTES)).alias("minutes")
    )
    counts = orders.filter(F.col("action").isNotNull()).groupBy(*RUN, "action").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(span, RUN).withColumn("per_minute", F.col("n") / F.col("minutes")).drop("minutes")


def quote_gaps(events: DataFrame) -> DataFrame:
    """Durations for which a side had no open order; an open gap ends at the run's last event.

    A gap starts at the first absent report after a present one and ends at the next present report.
    """
    end = events.filter(F.col("ts_ms").isNotNull()).groupBy(*RUN).agg(F.max("ts_ms").alias("_end"))
    sides = F.array(
        F.struct(F.lit("buy").alias("side_key"), F.col("open_bid_present").alias("present")),
        F.struct(F.lit("sell").alias("side_key"), F.col("open_ask_present").alias("present")),
    )
    rows = events.filter((event_name() == "open_orders_sync") & F.col("ts_ms").isNotNull()).select(*RUN, *ORDER, F.inline(sides))
    rows = rows.filter(F.col("present").isNotNull())
    place = [*RUN, "side_key"]
    near = ordered.over(rows, place, ORDER, _was=ordered.previous(F.col("present")))
    edges = near.filter(F.coalesce(F.col("_was") != F.col("present"), ~F.col("present")))
    # Edges alternate between start (absent) and end (present).
    paired = ordered.over(edges, place, ORDER, _next=ordered.following(F.col("ts_ms")))
    starts = paired.filter(~F.col("present")).join(end, RUN)
    return starts.select(
        *place, F.col("ts_ms").alias("start_ms"), (F.coalesce("_next", "_end") - F.col("ts_ms")).alias("gap_ms")
    )


def quote_gap_stats(gaps: DataFrame) -> DataFrame:
    """Summaries by side and over both sides."""
    both = gaps.unionByName(gaps.withColumn("side_key", F.lit("all")))
    return quantiles.summary(both, [*RUN, "side_key"], "gap_ms")


def sync_ages(events: DataFrame) -> DataFrame:
    """Age of the last open-orders sync at each event that reports or depends on it."""
    rows = events.filter(F.col("ts_ms").isNotNull()).withColumn("_e", event_name())
    synced = F.when(F.col("_e") == "open_orders_sync", F.col("ts_ms"))
    seen = ordered.over(rows, RUN, ORDER, _last=ordered.last_seen(synced))
    implied = F.when(F.col("_e").isin("quote_skip", "send_skip", "replace_guard"), F.col("_last"))
    age = F.col("ts_ms") - F.coalesce(F.col("last_open_orders_sync_ts"), implied)
    return seen.withColumn("age_ms", age).filter(F.col("age_ms") >= 0).select(*RUN, *ORDER, "age_ms")


def batch_gaps(orders: DataFrame) -> DataFrame:
    """Smallest time between consecutive batches, by the time of each batch's first order line."""
    first = orders.filter(F.col("batch_id").isNotNull() & F.col("ts_ms").isNotNull()).groupBy(*RUN, "batch_id").agg(
        F.min_by("ts_ms", "seq").alias("ts_ms")
    )
    near = ordered.over(first, RUN, ["ts_ms", "batch_id"], _p=ordered.previous(F.col("ts_ms")))
    return near.groupBy(*RUN).agg(F.min(F.col("ts_ms") - F.col("_p")).alias("min_batch_gap_ms"))


def account_state(states: DataFrame, coin: str) -> DataFrame:
    """Account figures with fallback to the cross summary, and the position row of one coin."""
    pick = lambda c: F.coalesce(F.col(f"margin_summary.{c}"), F.col(f"cross_summary.{c}"))
    own = F.try_element_at(F.filter("positions", lambda p: p["coin"] == coin), F.lit(1))
    out = states.withColumns(
        {
            "account_value": pick("account_value"),
            "total_margin_used": pick("total_margin_used"),
            "total_ntl_pos": pick("total_ntl_pos"),
            "total_raw_usd": pick("total_raw_usd"),
            "_own": own,
        }
    )
    return out.withColumns(
        {
            "available": F.col("account_value") - F.col("total_margin_used"),
            "position_size": F.col("_own.szi"),
            "entry_px": F.col("_own.entry_px"),
        }
    ).drop("_own", "margin_summary", "cross_summary", "positions")


def open_order_snapshot(snapshots: DataFrame) -> DataFrame:
    """Latest open order per snapshot and side, presence flags and the missing side."""
    latest = snapshots.groupBy(*RUN, "snapshot_ts").agg(
        *[
            F.max_by(
                F.when(F.col("side") == s, F.col("oid")), F.when(F.col("side") == s, F.struct("timestamp", "pos"))
            ).alias(f"{n}_oid")
            for s, n in (("buy", "bid"), ("sell", "ask"))
        ],
        F.count(F.col("oid")).alias("matched"),
    )
    bid, ask = F.col("bid_oid").isNotNull(), F.col("ask_oid").isNotNull()
    missing = (
        F.when(bid & ask, F.lit("none")).when(~bid & ~ask, F.lit("both")).when(bid, F.lit("ask")).otherwise(F.lit("bid"))
    )
    return latest.withColumns({"open_bid_present": bid, "open_ask_present": ask, "missing_side": missing})


def disappeared_orders(latest: DataFrame) -> DataFrame:
    """Order ids a side had in the previous snapshot and lost in this one, once per id."""
    sides = F.array(
        F.struct(F.lit("buy").alias("side_key"), F.col("bid_oid").alias("oid")),
        F.struct(F.lit("sell").alias("side_key"), F.col("ask_oid").alias("oid")),
    )
    rows = latest.select(*RUN, "snapshot_ts", F.inline(sides))
    near = ordered.over(rows, [*RUN, "side_key"], ["snapshot_ts"], _p=ordered.previous(F.col("oid")))
    gone = near.filter(F.col("_p").isNotNull() & F.col("oid").isNull())
    return gone.groupBy(*RUN, "side_key", F.col("_p").alias("oid")).agg(F.min("snapshot_ts").alias("snapshot_ts"))
