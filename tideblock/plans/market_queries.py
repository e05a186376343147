"""Queries over raw events, books, trades and candles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock import scratch
from tideblock.functions import book as bk
from tideblock.functions import rounding
from tideblock.functions import values as val
from tideblock.operators import blocks as bl
from tideblock.operators import candles as cd
from tideblock.plans import views as v
from tideblock.plans.catalog import query
from tideblock.sources import events as ev
from tideblock.sources import logs, sinks, zst

HOUR = v.HOUR_MS
# Two flow columns on every block, from the first block at or after each trade.
v.CTES.update(
    {
        "bucketed": (
            ["books", "trades"],
            """SELECT t.symbol, t.ts_ms, t.event_id, t.trade_id, t.side, t.px, t.sz, b.block_ts_ms, b.book_event_id FROM trades t
            ASOF JOIN (SELECT symbol, ts_ms AS block_ts_ms, min(event_id) AS book_event_id FROM books GROUP BY ALL) b
            ON t.symbol = b.symbol AND t.ts_ms <= b.block_ts_ms""",
        ),
        "blocks": (
            ["books", "bucketed"],
            """SELECT b.symbol, b.ts_ms AS block_ts_ms, b.event_id AS book_event_id, bid_px, bid_sz, ask_px, ask_sz,
            COALESCE(f.n_trades, 0) AS n_trades, f.signed_volume, COALESCE(f.signed_volume, 0) AS signed_volume_lenient, f.last_trade_px
            FROM books b LEFT JOIN (SELECT symbol, block_ts_ms, book_event_id, count(*) AS n_trades,
              sum(CASE WHEN side = 'buy' THEN sz ELSE -sz END) AS signed_volume, arg_max(px, (ts_ms, event_id)) AS last_trade_px
              FROM bucketed GROUP BY ALL) f
            ON f.symbol = b.symbol AND f.block_ts_ms = b.ts_ms AND f.book_event_id = b.event_id""",
        ),
        "features": (
            ["blocks"],
            """SELECT *, (bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz) AS microprice,
            (bid_sz - ask_sz) / (bid_sz + ask_sz) AS imbalance,
            (microprice - mid) / mid * 1e4 AS micro_bias_bps, (microprice - mid) / spread AS micro_pos,
            (last_trade_px - mid) / mid * 1e4 AS basis_bps, 1e4 * spread / mid AS market_spread_bps
            FROM (SELECT *, (bid_px + ask_px) / 2 AS mid, ask_px - bid_px AS spread FROM blocks)""",
        ),
        "state": (
            ["features"],
            """SELECT *, (mid - prev_mid) / prev_mid AS mid_ret, abs((mid - prev_mid) / prev_mid) AS abs_mid_ret FROM (
            SELECT *, lag(mid) OVER w AS prev_mid, lag(block_ts_ms) OVER w AS prev_ts, lead(mid) OVER w AS next_mid,
            lag(bid_px) OVER w AS prev_bid, lag(ask_px) OVER w AS prev_ask, lag(book_event_id) OVER w AS prev_id
            FROM features WINDOW w AS (PARTITION BY symbol ORDER BY block_ts_ms, book_event_id))""",
        ),
    }
)


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return bl.blocks(v.books(spark, sf).drop("run_id", "ts"), v.trades(spark, sf).drop("run_id", "ts"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return bl.features(blocks(spark, sf))


# ---- raw files: the given events in wire form, written by Spark and read back ----


def _wire(spark: SparkSession, sf: str) -> DataFrame:
    """Market events in the raw wire form, one JSON text per row, trades twice and with some rows that must fail."""
    text = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    head = lambda ch: [
        F.lit(ch).alias("channel"), F.concat("symbol", F.lit("-PERP")).alias("symbol"), F.col("ts_ms").alias("recv_ts_ms"), "ts_ms",
    ]
    level = lambda side: F.when(
        F.col(f"{side}_px").isNotNull(), F.array(F.array(text(f"{side}_px"), text(f"{side}_sz")))
    ).otherwise(F.array().cast("array<array<string>>"))
    made_id = F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id")
    books = v.books(spark, sf).select(*head("l2Book"), made_id, level("bid").alias("bids"), level("ask").alias("asks"))
    deals = v.trades(spark, sf).select(*head("trades"), made_id, text("px").alias("px"), text("sz").alias("sz"), "side", "trade_id")
    again = deals.withColumns({"recv_ts_ms": F.col("recv_ts_ms") + 5, "event_id": F.concat("event_id", F.lit("b"))})
    ctx = v.contexts(spark, sf).select(*head("activeAssetCtx"), F.lit("").alias("event_id"), F.struct("oracle_gap").alias("metadata"),
        F.when(F.col("status") == "halted", F.lit(" ")).otherwise(F.col("status")).alias("status"))
    fund = v.fundings(spark, sf).select(*head("userFundings"), F.col("funding_id").cast("string").alias("funding_id"),
        text("amount").alias("amount"), F.lit("0.0001").alias("rate"))
    fill = v.deals(spark, sf).select(*head("userFills"), text("px").alias("px"), text("sz").alias("sz"), F.col("fee").cast("string").alias("fee"), "side",
        "trade_id", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("event_id"))
    bbo = v.books(spark, sf).select(*head("bbo"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("event_id"),
        *[text(c).alias(c) for c in bl.TOP])
    parts = [books, deals, again, ctx, fund, fill, bbo]
    lines = [p.select(F.to_json(F.struct(*p.columns)).alias("value")) for p in parts]
    out = lines[0]
    for part in lines[1:]:
        out = out.unionByName(part)
    return out


_written: dict[tuple[str, str], str] = {}


def raw_files(spark: SparkSession, sf: str) -> str:
    """The wire files of ``sf``, written once per application."""
    key = (spark.conf.get("spark.app.id", ""), sf)
    if key not in _written:
        path = scratch.new_path(spark, "wire")
        _wire(spark, sf).write.text(f"{path}/day", compression="gzip")
        _written[key] = path
    return _written[key]


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.read_raw(spark, raw_files(spark, sf), "*.txt*", None)


_WIRE = """wire AS (
  SELECT 'l2Book' AS ch, 'book' AS kind, symbol, ts_ms, 'e' || event_id AS id, true AS ok FROM books
  UNION ALL SELECT 'trades', 'trade', symbol, ts_ms, 'e' || event_id, true FROM trades
  UNION ALL SELECT 'trades', 'trade', symbol, ts_ms, 'e' || event_id || 'b', true FROM trades
  UNION ALL SELECT 'activeAssetCtx', 'asset_ctx', symbol, ts_ms, 'activeAssetCtx:' || symbol || '-PERP:' || ts_ms, status <> 'halted' FROM contexts
  UNION ALL SELECT 'userFundings', 'user_funding', symbol, ts_ms, 'userFundings:' || symbol || '-PERP:' || ts_ms, true FROM fundings
  UNION ALL SELECT 'userFills', 'user_fill', symbol, ts_ms, 'f' || event_id, true FROM trades
  UNION ALL SELECT 'bbo', 'bbo', symbol, ts_ms, 'q' || event_id, bid_px IS NOT NULL FROM books)"""
_WIRE_NEEDS = "books trades contexts fundings"


@query("a1_scan_raw_jsonl", _WIRE_NEEDS, f"WITH {_WIRE} SELECT ch AS channel, symbol || '-PERP' AS symbol, count(*) AS n, max(ts_ms) AS last_ms FROM wire GROUP BY ALL")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return raw_events(spark, sf).groupBy("channel", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))


@query("a2_scan_raw_zst", _WIRE_NEEDS, f"WITH {_WIRE} SELECT ch AS channel, symbol || '-PERP' AS symbol, count(*) AS n, max(ts_ms) AS last_ms FROM wire GROUP BY ALL")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    events = ev.parse_lines(zst.read_lines(_zst_files(spark, sf), 1 << 16))
    return events.groupBy("channel", "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))


def _zst_files(spark: SparkSession, sf: str) -> DataFrame:
    """The wire lines in files as ``binaryFile`` has them: frames that cut lines anywhere, every other one with its size in the header."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for n, batch in enumerate(batches):
            text = "\n".join(batch.column(0).to_pylist()).encode()
            frames = [zstandard.ZstdCompressor(write_content_size=bool(at & 4096)).compress(text[at : at + 4096]) for at in range(0, len(text), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{n}.jsonl.zst"]), pa.array([b"".join(frames)], pa.binary())], names=["path", "content"])

    return scratch.keep(_wire(spark, sf).mapInArrow(pack, "path string, content binary"), "wire_zst")


@query("a3_scan_tree", _WIRE_NEEDS, f"WITH {_WIRE} SELECT count(*) AS n, true AS has_file FROM wire")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return raw_events(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("source_file").contains("/day/")).alias("has_file")
    )


@query("a4_parse_events", _WIRE_NEEDS, f"WITH {_WIRE} SELECT kind AS event_type, ok AS is_valid, count(*) AS n FROM wire GROUP BY ALL")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return ev.parse_events(raw_events(spark, sf)).groupBy("event_type", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query("a4_quarantine", _WIRE_NEEDS, f"""WITH {_WIRE} SELECT kind AS event_type,
    CASE WHEN kind = 'bbo' THEN 'bid_px,bid_sz,ask_px,ask_sz' ELSE 'status' END AS errors, count(*) AS n FROM wire WHERE NOT ok GROUP BY ALL""")
def a4q(spark: SparkSession, sf: str) -> DataFrame:
    bad = ev.quarantine(ev.parse_events(raw_events(spark, sf)))
    return bad.groupBy("event_type", F.concat_ws(",", "errors").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("a4a_parse_books", "books", "SELECT 'e' || event_id AS event_id, bid_px, bid_sz, ask_px, ask_sz, bid_px IS NULL AS missing_book FROM books", "bid_px bid_sz ask_px ask_sz")
def a4a(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "book")
    return rows.select(
        "event_id", bk.book_top(F.col("bids"), F.col("asks")).alias("top"), bk.missing_book(F.col("bids"), F.col("asks")).alias("missing_book")
    ).select("event_id", "top.*", "missing_book")


@query("a4b_parse_bbo", "books", "SELECT 'q' || event_id AS event_id, bid_px, bid_sz, ask_px, ask_sz FROM books WHERE bid_px IS NOT NULL", "bid_px bid_sz ask_px ask_sz")
def a4b(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "bbo")
    return rows.select("event_id", *bl.TOP)


@query("a4d_parse_contexts", "contexts", "SELECT ts_ms, status, oracle_gap FROM contexts WHERE status = 'open'", "oracle_gap")
def a4d(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "asset_ctx")
    return rows.select("ts_ms", "status", F.get_json_object("metadata", "$.oracle_gap").cast("double").alias("oracle_gap"))


@query("a4e_parse_user_fills", "deals", "SELECT trade_id, side, px, sz, fee FROM deals", "px sz fee")
def a4e(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "user_fill")
    return rows.select("trade_id", "side", "px", "sz", "fee")


@query("a4f_parse_user_fundings", "fundings", "SELECT CAST(funding_id AS VARCHAR) AS funding_id, ts_ms, amount FROM fundings", "amount")
def a4f(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "user_funding")
    return rows.select("funding_id", "ts_ms", "amount")


@query("a5_default_event_id", _WIRE_NEEDS, f"WITH {_WIRE} SELECT id AS event_id, count(*) AS n FROM wire WHERE ok GROUP BY ALL")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return ev.valid(ev.parse_events(raw_events(spark, sf))).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("a6_event_records", "trades", "SELECT 'e' || event_id AS event_id, CAST(px AS DOUBLE) AS px, CAST(CAST(sz AS BIGINT) AS VARCHAR) AS sz_text, side, trade_id FROM trades", "px")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    rows = ev.dedupe(ev.valid(ev.parse_events(raw_events(spark, sf)))).filter(F.col("event_type") == "trade")
    flat = ev.as_records(rows)
    return flat.select("event_id", F.col("px").cast("double").alias("px"), F.col("sz").alias("sz_text"), "side", "trade_id")


@query("a9_convert_raw", _WIRE_NEEDS, f"""WITH {_WIRE} SELECT kind AS event_type, symbol || '-PERP' AS symbol,
    count(DISTINCT CASE WHEN kind = 'trade' THEN rtrim(id, 'b') ELSE id END) AS n FROM wire WHERE ok GROUP BY ALL""")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch.new_path(spark, "silver")
    ev.convert_raw(spark, raw_files(spark, sf), out, "*.txt*")
    return spark.read.parquet(out).groupBy("event_type", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("a7_a8_parquet_round_trip", "features", "SELECT symbol, count(*) AS n, sum(mid) AS mids FROM features WHERE n_trades > 0 GROUP BY ALL", "mids")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "features")
    sinks.write_dated(features(spark, sf), path, ["symbol"], at="block_ts_ms")
    back = spark.read.parquet(path)
    return back.filter(F.col("n_trades") > 0).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("mid").alias("mids"))


@query("a11_scan_node_trades", "trades", "SELECT symbol, side, count(*) AS n, sum(px * sz) AS notional FROM trades WHERE symbol = 'S3' GROUP BY ALL", "notional")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "node")
    v.trades(spark, sf).select(
        F.col("symbol").alias("coin"), F.when(F.col("side") == "buy", F.lit("B")).otherwise(F.lit("A")).alias("side"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), F.col("px").cast("string").alias("px"),
        F.col("sz").cast("string").alias("sz"), F.col("event_id").alias("tid"),
    ).write.option("compression", "gzip").json(f"{path}/node_trades/hourly")
    rows = ev.read_node_trades(spark, path, "S3", 0, 4_102_444_800_000)
    return rows.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("px").cast("double") * F.col("sz").cast("double")).alias("notional")
    )


@query("a16_normalize_book_wire", "books", "SELECT event_id, CASE WHEN bid_px IS NULL THEN 0 ELSE 2 END AS n_bids, bid_px AS best_bid, ask_px + 1 AS second_ask FROM books", "best_bid second_ask", "n_bids")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    b = v.books(spark, sf)
    level = lambda c, d: F.struct((F.col(f"{c}_px") + d).cast("string").alias("px"), F.col(f"{c}_sz").cast("string").alias("sz"))
    three = lambda c, s: F.when(F.col(f"{c}_px").isNotNull(), F.array(*[level(c, s * i) for i in range(3)])).otherwise(
        F.array().cast("array<struct<px: string, sz: string>>")
    )
    pairs = lambda c, s: F.transform(three(c, s), lambda x: F.array(x["px"], x["sz"]))
    nested = F.col("event_id") % 2 == 0
    wire = b.select(
        "event_id",
        F.when(nested, F.array(three("bid", -1), three("ask", 1))).alias("levels"),
        F.when(~nested, pairs("bid", -1)).alias("bids"), F.when(~nested, pairs("ask", 1)).alias("asks"),
    )
    cut = wire.select("event_id", ev.book_levels("bids", 2).alias("b"), ev.book_levels("asks", 2).alias("a"))
    return cut.select(
        "event_id", F.size("b").alias("n_bids"), F.get("b", F.lit(0))["px"].alias("best_bid"), F.get("a", F.lit(1))["px"].alias("second_ask")
    )


# ---- projections and scalar functions ----


@query("b1_canonical_symbol", "base", "SELECT symbol AS canonical, count(*) AS n FROM base GROUP BY ALL")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["s{}-PERP", "S{}/USDC:PERP", " s{}_", "S{}usdcperp"]
    b = v.base(spark, sf)
    n = (F.col("user_id") % v.SYMBOLS).cast("string")
    shapes = F.element_at(F.array(*[F.replace(F.lit(f), F.lit("{}"), n) for f in forms]), (F.col("event_id") % 4 + 1).cast("int"))
    return b.groupBy(val.canonical_symbol(shapes).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_filter_symbol", "trades", "SELECT symbol, count(*) AS n FROM trades WHERE symbol = 'S2' GROUP BY ALL")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return ev.filter_symbol(v.trades(spark, sf), "s2-perp").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("b3_normalize_side", "log_fills", "SELECT CASE side WHEN 'B' THEN 'buy' WHEN 'A' THEN 'sell' END AS side, count(*) AS n FROM log_fills GROUP BY ALL")
def b3(spark: SparkSession, sf: str) -> DataFrame:
    return v.log_fills(spark, sf).groupBy(val.normalize_side(F.concat(F.lit(" "), "side")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("b4_to_decimal", "base", "SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS number FROM base", "number")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "click", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return v.base(spark, sf).select("event_id", val.to_decimal(text).alias("number"))


@query("b5_validate_event", _WIRE_NEEDS, f"WITH {_WIRE} SELECT symbol || '-PERP' AS symbol, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad FROM wire GROUP BY ALL")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return ev.parse_events(raw_events(spark, sf)).groupBy("symbol").agg(
        F.count_if("is_valid").alias("good"), F.count_if(~F.col("is_valid")).alias("bad")
    )


@query("b6_event_time", "base", "SELECT event_id, CASE WHEN k > 50 THEN ts_ms ELSE ts_ms + 17 END AS event_ms FROM base")
def b6(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("k") > 50, F.col("ts_ms"))
    return v.base(spark, sf).select("event_id", val.event_time(own, F.col("ts_ms") + 17).alias("event_ms"))


@query("b7_book_top", "books", """SELECT event_id, bid_px AS best_bid, bid_sz AS best_bid_sz, ask_px AS best_ask, ask_sz AS best_ask_sz FROM books""",
       "best_bid best_bid_sz best_ask best_ask_sz")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    b = v.books(spark, sf)
    lv = lambda px, sz: F.struct(px.alias("px"), sz.alias("sz"))
    ladder = lambda c, s: F.when(
        F.col(f"{c}_px").isNotNull(),
        F.array(
            lv(F.col(f"{c}_px") + s, F.col(f"{c}_sz") * 3), lv(F.col(f"{c}_px"), F.col(f"{c}_sz")), lv(F.col(f"{c}_px"), F.col(f"{c}_sz") * 2)
        ),
    )
    top = bk.book_top(ladder("bid", -1.0), ladder("ask", 1.0))
    return b.select("event_id", top.alias("t")).select(
        "event_id", F.col("t.bid_px").alias("best_bid"), F.col("t.bid_sz").alias("best_bid_sz"),
        F.col("t.ask_px").alias("best_ask"), F.col("t.ask_sz").alias("best_ask_sz"),
    )


@query("b8_missing_flags", "features", "SELECT symbol, count(*) FILTER (bid_px IS NULL) AS missing_book, count(*) FILTER (n_trades = 0) AS missing_trades FROM features GROUP BY ALL")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).groupBy("symbol").agg(
        F.count_if(F.col("bid_px").isNull() & F.col("ask_px").isNull()).alias("missing_book"), F.count_if("missing_trades").alias("missing_trades")
    )


_STATE_COLS = "mid mid_ret abs_mid_ret market_spread_bps imbalance microprice micro_bias_bps micro_pos"


@query("b9_market_state_columns", "state", f"SELECT symbol, block_ts_ms, book_event_id, {', '.join(_STATE_COLS.split())} FROM state", _STATE_COLS)
def b9(spark: SparkSession, sf: str) -> DataFrame:
    return bl.market_state(blocks(spark, sf)).select("symbol", *bl.BLOCK, *_STATE_COLS.split())


@query("b15_round_price", "base", """SELECT event_id, CASE WHEN x >= 10000 THEN round(x, 0) WHEN x >= 1000 THEN round(x, 1) ELSE x END AS price
  FROM (SELECT event_id, CAST(value AS DECIMAL(18,2)) * (1 + k) AS x FROM base)""", "price")
def b15(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("value").cast("decimal(18,2)") * (1 + F.col("k"))).cast("decimal(38,18)")
    return v.base(spark, sf).select("event_id", rounding.round_price(x, 4).alias("price"))


@query("b16_round_size", "base", "SELECT event_id, round(CAST(value AS DECIMAL(18,2)), 1) AS size FROM base", "size")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    return v.base(spark, sf).select("event_id", rounding.round_size(F.col("value").cast("decimal(18,2)"), 1).alias("size"))


@query("b17_price_tick", "base", """SELECT event_id, CASE WHEN value = 0 THEN NULL ELSE pow(10, -length(split_part(CAST(value AS VARCHAR), '.', 2))) END AS tick FROM base""", "tick")
def b17(spark: SparkSession, sf: str) -> DataFrame:
    return v.base(spark, sf).select("event_id", val.price_tick(F.col("value")).alias("tick"))


@query("b19_one_tick_spread", "log_orders", "SELECT run_id, count(*) FILTER (abs(pre_send_spread_ticks - 1) <= 0.25) AS one_tick FROM log_orders GROUP BY ALL")
def b19(spark: SparkSession, sf: str) -> DataFrame:
    return v.log_orders(spark, sf).groupBy("run_id").agg(F.count_if(val.one_tick_spread(F.col("pre_send_spread_ticks"))).alias("one_tick"))


@query("b20_normalize_client_id", "base", "SELECT event_id, CASE WHEN k = 0 THEN NULL ELSE 'c' || user_id END AS cloid FROM base")
def b20(spark: SparkSession, sf: str) -> DataFrame:
    own = F.concat(F.lit(" c"), F.col("user_id").cast("string"), F.lit(" "))
    nested = F.when(F.col("k") % 2 == 1, F.to_json(F.struct(F.lit(" ").alias("cloid"), own.alias("clientOid"))))
    text = F.when(F.col("k") == 0, F.lit("  ")).otherwise(F.coalesce(nested, own))
    return v.base(spark, sf).select("event_id", val.client_id(text).alias("cloid"))


@query("b26_finite_filter", "base", "SELECT event_type, count(*) AS n FROM base WHERE k <> 0 AND k <> 1 AND k <> 2 GROUP BY ALL")
def b26(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k > 2, F.col("value"))
    return v.base(spark, sf).filter(val.finite(odd)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_CANDLE_BLOCKS = """WITH bars AS (SELECT symbol, ts_ms // 3600000 * 3600000 AS t, arg_max(px, (ts_ms, event_id)) AS c FROM trades GROUP BY ALL)
  SELECT symbol, t + 3599999 AS block_ts_ms, 'candle:' || symbol || ':1h:' || t AS book_event_id, c * (1 - 0.00025) AS bid_px, 1.0 AS bid_sz,
  c * (1 + 0.00025) AS ask_px, 1.0 AS ask_sz, false AS missing_book, true AS missing_trades FROM bars"""


@query("b28_candle_blocks", "trades", _CANDLE_BLOCKS, "bid_px bid_sz ask_px ask_sz")
def b28(spark: SparkSession, sf: str) -> DataFrame:
    return cd.to_blocks(cd.ohlcv(v.trades(spark, sf), cd.interval_ms("1h")), 5.0, "1h")


# A limit is what F4 is: the first bars in time order.
@query("b28_f4_candle_blocks", "trades", f"{_CANDLE_BLOCKS} ORDER BY t, symbol LIMIT 500", "bid_px bid_sz ask_px ask_sz")
def b28_f4(spark: SparkSession, sf: str) -> DataFrame:
    bars = cd.first_bars(cd.ohlcv(v.trades(spark, sf), cd.interval_ms("1h")), 500)
    return cd.to_blocks(bars, 5.0, "1h")


@query("b29_spread_filter_flag", "features", "SELECT symbol, count(*) FILTER (market_spread_bps < 5) AS too_tight FROM features GROUP BY ALL")
def b29(spark: SparkSession, sf: str) -> DataFrame:
    b = v.books(spark, sf).withColumns(bk.book_columns(*bl.TOP))
    return b.groupBy("symbol").agg(F.count_if(F.col("market_spread_bps") < 5).alias("too_tight"))


@query("b34_book_validity", "books", """SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN bid_px IS NULL THEN 'missing_best_bid_ask'
  WHEN ask_px - 0.04::DOUBLE <= bid_px THEN 'crossed_or_stale_book' END AS skip_reason FROM books) GROUP BY ALL""")
def b34(spark: SparkSession, sf: str) -> DataFrame:
    return v.books(spark, sf).groupBy(bk.book_validity(F.col("bid_px"), F.col("ask_px") - 0.04).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- alignment ----


@query("c1_bucket_trades", "bucketed", "SELECT event_id, block_ts_ms, book_event_id FROM bucketed")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    return bl.bucket_trades(v.trades(spark, sf), v.books(spark, sf)).select("event_id", *bl.BLOCK)


@query("c1_nested_blocks_clipped_b25", "bucketed", """SELECT symbol, block_ts_ms, book_event_id, part, count(*) AS n_all,
  count(*) FILTER (ts_ms >= block_ts_ms - 3600000) AS n_kept, string_agg(trade_id, ',' ORDER BY ts_ms, event_id) AS trade_ids FROM
  (SELECT *, (row_number() OVER (PARTITION BY symbol, block_ts_ms, book_event_id ORDER BY ts_ms, event_id) - 1) // 10000 AS part FROM bucketed) GROUP BY ALL""")
def c1n(spark: SparkSession, sf: str) -> DataFrame:
    rows = bl.bucket_trades(v.trades(spark, sf), v.books(spark, sf))
    nested = bl.nested_trades(rows).withColumnRenamed("trade_bucket", "all_trades").withColumn("trade_bucket", F.col("all_trades"))
    clipped = bl.clip_bucket(nested, F.col("block_ts_ms") - HOUR)
    return clipped.select(
        "symbol", *bl.BLOCK, "part", F.size("all_trades").alias("n_all"), F.size("trade_bucket").alias("n_kept"),
        F.concat_ws(",", F.transform("all_trades", lambda t: t["trade_id"])).alias("trade_ids"),
    )


@query("c2_asof_context", "books contexts", """SELECT b.symbol, b.ts_ms AS block_ts_ms, b.event_id AS book_event_id, c.status AS ctx_status, c.oracle_gap AS ctx_gap, c.ts_ms AS ctx_ts_ms
  FROM books b ASOF LEFT JOIN (SELECT symbol, ts_ms, arg_max(status, event_id) AS status, arg_max(oracle_gap, event_id) AS oracle_gap FROM contexts GROUP BY ALL) c
  ON b.symbol = c.symbol AND b.ts_ms >= c.ts_ms""", "ctx_gap")
def c2(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.books(spark, sf).select("symbol", F.col("ts_ms").alias("block_ts_ms"), F.col("event_id").alias("book_event_id"))
    hit = bl.carry_forward(rows, v.contexts(spark, sf), ["status", "oracle_gap"], "ctx_last")
    return hit.select("symbol", *bl.BLOCK, F.col("ctx_last.status").alias("ctx_status"), F.col("ctx_last.oracle_gap").alias("ctx_gap"), F.col("ctx_last.at_ms").alias("ctx_ts_ms"))


@query("c3_asof_bbo", "books trades", """SELECT t.event_id, q.bid_px AS bbo_bid, q.ask_px AS bbo_ask, q.ts_ms AS bbo_ts_ms FROM trades t ASOF LEFT JOIN
  (SELECT symbol, ts_ms, b.bid_px, b.ask_px FROM (SELECT symbol, ts_ms, arg_max({bid_px: bid_px, ask_px: ask_px}, event_id) AS b FROM books GROUP BY ALL)) q
  ON t.symbol = q.symbol AND t.ts_ms >= q.ts_ms""", "bbo_bid bbo_ask")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.trades(spark, sf).select("symbol", F.col("ts_ms").alias("block_ts_ms"), "event_id")
    hit = bl.carry_forward(rows, v.books(spark, sf), bl.TOP, "bbo_last")
    return hit.select("event_id", F.col("bbo_last.bid_px").alias("bbo_bid"), F.col("bbo_last.ask_px").alias("bbo_ask"), F.col("bbo_last.at_ms").alias("bbo_ts_ms"))


# ---- aggregates, windows, sorts, sets ----


@query("d1_dedupe_events", "trades", "SELECT symbol || '-PERP:' || trade_id || ':' || ts_ms AS dedupe_key, 'e' || event_id AS event_id, ts_ms AS recv_ts_ms FROM trades")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    trades = ev.valid(ev.parse_events(raw_events(spark, sf))).filter(F.col("event_type") == "trade")
    return ev.dedupe(trades).select("dedupe_key", "event_id", "recv_ts_ms").orderBy("dedupe_key")


_BAR_SQL = """SELECT symbol, ts_ms // {n} * {n} AS t, arg_min(px, (ts_ms, event_id)) AS o, max(px) AS h, min(px) AS l, arg_max(px, (ts_ms, event_id)) AS c,
  sum(sz) AS v, count(*) AS n, ts_ms // {n} * {n} + {n} - 1 AS t_end FROM trades GROUP BY ALL"""


@query("d2_ohlcv_1m", "trades", _BAR_SQL.format(n=60_000), "o h l c v")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return cd.ohlcv(v.trades(spark, sf), cd.interval_ms("1m"))


@query("d2_ohlcv_1h_from_1m", "trades", _BAR_SQL.format(n=3_600_000), "o h l c v")
def d2h(spark: SparkSession, sf: str) -> DataFrame:
    return cd.roll_up(cd.ohlcv(v.trades(spark, sf), cd.interval_ms("1m")), cd.interval_ms("1h"))


@query("a10_d3_rollup_candles", "trades", _BAR_SQL.format(n=2_700_000), "o h l c v")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "candles")
    sinks.write_candles(cd.ohlcv(v.trades(spark, sf), cd.interval_ms("15m")), path, "15m")
    back = logs.read_candles(spark, path, one_array_per_file=False)
    return cd.roll_up(back, cd.interval_ms("45m")).select("symbol", "t", "o", "h", "l", "c", "v", "n", "t_end")


_HASH8 = "substr(sha256(COALESCE(bid_px::VARCHAR, 'None') || ':' || COALESCE(ask_px::VARCHAR, 'None') || ':' || COALESCE(bid_sz::VARCHAR, 'None') || ':' || COALESCE(ask_sz::VARCHAR, 'None')), 1, 8)"


@query("d47_h14_book_change_diag", "state", f"""SELECT symbol, count(*) AS samples,
  count(*) FILTER (prev_id IS NOT NULL AND (bid_px IS DISTINCT FROM prev_bid OR ask_px IS DISTINCT FROM prev_ask)) AS top_changes, count(*) FILTER (h <> prev_h) AS book_changes,
  count(DISTINCT COALESCE(bid_px, -1) || ':' || COALESCE(ask_px, -1)) AS unique_tops, count(DISTINCT h) AS unique_hashes FROM
  (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY block_ts_ms, book_event_id) AS prev_h FROM (SELECT *, {_HASH8} AS h FROM state)) GROUP BY ALL""")
def d47(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.books(spark, sf).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    return bl.book_change_summary(rows).select("symbol", "samples", "top_changes", "book_changes", "unique_tops", "unique_hashes")


@query("h14_book_hash8", "books", f"SELECT event_id, {_HASH8} AS hash8 FROM books")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    return v.books(spark, sf).select("event_id", bk.book_hash8(*[F.col(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz")]).alias("hash8"))


@query("e1_mid_ret", "state", "SELECT symbol, book_event_id, mid_ret, abs_mid_ret FROM state", "mid_ret abs_mid_ret")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.books(spark, sf).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    return bl.market_state(rows).select("symbol", "book_event_id", "mid_ret", "abs_mid_ret")


@query("e2_mid_ret_with_gap_reset", "state", """SELECT symbol, book_event_id, COALESCE(block_ts_ms - prev_ts >= 7200000, false) AS reconnect,
  CASE WHEN block_ts_ms - prev_ts < 7200000 THEN mid_ret END AS mid_ret FROM state""", "mid_ret")
def e2(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.books(spark, sf).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    return bl.market_state(rows, reconnect_gap_ms=2 * HOUR).select("symbol", "book_event_id", "reconnect", "mid_ret")


@query("e3_rolling_signed_volume", "blocks", """SELECT symbol, block_ts_ms, book_event_id, (SELECT sum(p.signed_volume_lenient) FROM blocks p WHERE p.symbol = b.symbol
  AND p.block_ts_ms >= b.block_ts_ms - 21600000 AND (p.block_ts_ms, p.book_event_id) <= (b.block_ts_ms, b.book_event_id)) AS signed_volume_window FROM blocks b""", "signed_volume_window")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    rows = blocks(spark, sf).select("symbol", *bl.BLOCK, "signed_volume_lenient")
    return bl.rolling_sum(rows, "signed_volume_lenient", 6 * HOUR).select("symbol", *bl.BLOCK, "signed_volume_window")


@query("e4_forward_and_present_returns", "state", "SELECT symbol, book_event_id, mid_ret AS ret_now, (next_mid - mid) / mid AS fwd_ret FROM state", "ret_now fwd_ret")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    from tideblock.operators import ordered

    rows = v.books(spark, sf).select("symbol", F.col("ts_ms").alias("block_ts_ms"), F.col("event_id").alias("book_event_id"), bk.mid(F.col("bid_px"), F.col("ask_px")).alias("mid"))
    near = ordered.over(rows, bl.KEYS, bl.BLOCK, p=ordered.previous(F.col("mid")), n=ordered.following(F.col("mid")))
    return near.select("symbol", "book_event_id", bk.simple_return(F.col("mid"), F.col("p")).alias("ret_now"), bk.simple_return(F.col("n"), F.col("mid")).alias("fwd_ret"))


@query("e10_change_flags", "state", """SELECT symbol, book_event_id, prev_id IS NOT NULL AND (bid_px IS DISTINCT FROM prev_bid OR ask_px IS DISTINCT FROM prev_ask) AS top_px_change,
  prev_id IS NOT NULL AND mid IS DISTINCT FROM prev_mid AS mid_change FROM state""")
def e10(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.books(spark, sf).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    return bl.market_state(rows).select("symbol", "book_event_id", "top_px_change", "mid_change")


@query("f1_f2_sorted_blocks", "books", "SELECT ts_ms AS block_ts_ms, event_id AS book_event_id FROM books ORDER BY COALESCE(ts_ms, 0), COALESCE(event_id, 0)")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    b = v.books(spark, sf)
    return b.orderBy(F.coalesce("ts_ms", F.lit(0)), F.coalesce("event_id", F.lit(0))).select(F.col("ts_ms").alias("block_ts_ms"), F.col("event_id").alias("book_event_id"))


@query("f9_trades_old_to_new", "trades", "SELECT ts_ms, event_id FROM trades ORDER BY ts_ms, event_id")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return v.trades(spark, sf).orderBy("ts_ms", "event_id").select("ts_ms", "event_id")


@query("g1_union_of_files", "base", "SELECT event_type, count(*) AS n FROM base GROUP BY ALL")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch.new_path(spark, "parts")
    v.base(spark, sf).select("event_id", "event_type").repartition(4, "event_id").write.parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("g3_distinct_tops", "books", "SELECT DISTINCT symbol, bid_px, ask_px FROM books", "bid_px ask_px")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return v.books(spark, sf).select("symbol", "bid_px", "ask_px").distinct()


_FEATURES = "mid spread microprice micro_bias_bps micro_pos imbalance signed_volume basis_bps"


@query("h1_h8_block_features", "features", f"""SELECT symbol, block_ts_ms, book_event_id, {', '.join(_FEATURES.split())},
  {', '.join(f'{c} IS NULL AS missing_{c}' for c in _FEATURES.split())}, n_trades = 0 AS missing_trades FROM features""", _FEATURES)
def h1(spark: SparkSession, sf: str) -> DataFrame:
    names = _FEATURES.split()
    return features(spark, sf).select("symbol", *bl.BLOCK, *names, *[f"missing_{c}" for c in names], "missing_trades")


@query("h6_h7_signed_volume", "blocks", "SELECT symbol, book_event_id, signed_volume, signed_volume_lenient, last_trade_px FROM blocks", "signed_volume signed_volume_lenient last_trade_px")
def h6(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf).select("symbol", "book_event_id", "signed_volume", "signed_volume_lenient", "last_trade_px")


@query("h9_market_spread_bps", "books", "SELECT event_id, 1e4 * (ask_px - bid_px) / ((ask_px + bid_px) / 2) AS market_spread_bps FROM books", "market_spread_bps")
def h9(spark: SparkSession, sf: str) -> DataFrame:
    return v.books(spark, sf).withColumns(bk.book_columns(*bl.TOP)).select("event_id", "market_spread_bps")


@query("h10_h16_safe_casts", "base", """SELECT event_type, count(*) FILTER (k % 4 <> 3) AS numbers, count(*) FILTER (k % 4 IN (0, 1)) AS truths FROM base GROUP BY ALL""")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    text = v._pick(["1.5", " YES ", "nan?", "0"], F.col("k"))
    number = val.to_double(v._pick(["1.5", "2", "0", "x"], F.col("k")))
    return v.base(spark, sf).groupBy("event_type").agg(F.count(number).alias("numbers"), F.count_if(val.truthy(text)).alias("truths"))


@query("h11_decimal_text", "base", "SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS text FROM base")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    return v.base(spark, sf).select("event_id", val.decimal_text(F.col("value").cast("decimal(38,18)"), strip_zeros=True).alias("text"))


@query("h13_time_tag", "base", "SELECT strftime(make_timestamp(ts_ms * 1000), '%Y%m%d_%H%M') AS tag, count(*) AS n FROM base GROUP BY ALL")
def h13(spark: SparkSession, sf: str) -> DataFrame:
    return v.base(spark, sf).groupBy(val.time_tag(F.col("ts_ms")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("h15_nested_get", "base", "SELECT event_id, CASE WHEN k % 5 = 0 THEN k END AS depth FROM base", "", "depth")
def h15(spark: SparkSession, sf: str) -> DataFrame:
    """Present, a null on the way, another field, a number on the way, and no JSON at all."""
    k = F.col("k").cast("string")
    doc = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit('{"a": {"b": '), k, F.lit("}}"))).when(F.col("k") % 5 == 1, F.lit('{"a": null}'))
        .when(F.col("k") % 5 == 2, F.concat(F.lit('{"a": {"c": '), k, F.lit('}, "b": 1}'))).when(F.col("k") % 5 == 3, F.lit('{"a": 7}')).otherwise(F.lit("[not json"))
    )
    return v.base(spark, sf).select("event_id", F.get_json_object(doc, "$.a.b").cast("bigint").alias("depth"))
