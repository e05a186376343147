"""Values, rounding, books, blocks, candles and raw files: closed-form cases."""

from __future__ import annotations

import gzip
import json
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
import zstandard
from pyspark.sql import functions as F

from tideblock.functions import book as bk
from tideblock.functions import rounding
from tideblock.functions import values as val
from tideblock.operators import blocks as bl
from tideblock.operators import candles as cd
from tideblock.sources import events as ev
from tideblock.sources import logs, sinks, zst

BOOK = "symbol string, event_id string, ts_ms bigint, bid_px double, bid_sz double, ask_px double, ask_sz double"
TRADE = "symbol string, event_id string, ts_ms bigint, trade_id string, side string, px double, sz double"


def test_rounding_is_half_up_to_five_digits_and_a_cap(spark):
    """Against the definition in exact decimals, over prices of many sizes, ties included."""
    r = random.Random(12)
    prices = [Decimal(r.randint(-(10**8), 10**8)).scaleb(-r.randint(0, 12)) for _ in range(200)] + [Decimal("2.00005"), Decimal("-31.0015"), Decimal("0.0000015"), Decimal("77777.5"), Decimal(0)]

    def price(x: Decimal, cap: int) -> Decimal:
        places = min(cap, 4 - x.adjusted()) if x else 0
        return x.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)

    df = spark.createDataFrame([(str(x),) for x in prices], "x string")
    got = df.select("x", rounding.round_price(F.col("x")).alias("p"), rounding.round_price(F.col("x"), 3).alias("q"), rounding.round_size(F.col("x"), 4).alias("s")).collect()
    for row in got:
        x = Decimal(row.x)
        assert (row.p, row.q, row.s) == (price(x, 6), price(x, 3), x.quantize(Decimal("0.0001"), ROUND_HALF_UP)), row.x


def test_values(spark):
    names = [("eth-PERP", "ETH"), (" BTC/USDC:PERP ", "BTC"), ("perp", "PERP"), ("USDCPERP", "USDCPERP"), ("@107", "@107")]
    for r in spark.createDataFrame(names, "x string, want string").select(val.canonical_symbol(F.col("x")).alias("got"), "want").collect():
        assert r.got == r.want
    sides = [("B", "buy"), (" Ask ", "sell"), ("s", "sell"), ("x", None)]
    for r in spark.createDataFrame(sides, "x string, want string").select(val.normalize_side(F.col("x")).alias("got"), "want").collect():
        assert r.got == r.want
    ids = [(" a ", "a"), ("  ", None), (json.dumps({"hex": "0x1"}), "0x1"), (json.dumps({"cloid": "", "id": 7}), "7")]
    for r in spark.createDataFrame(ids, "x string, want string").select(val.client_id(F.col("x")).alias("got"), "want").collect():
        assert r.got == r.want
    texts = [("Post only order Would Cross", "post_only_reject"), ("insufficient margin", "insufficient_margin"), ("hm", None)]
    for r in spark.createDataFrame(texts, "x string, want string").select(val.order_error_class(F.col("x")).alias("got"), "want").collect():
        assert r.got == r.want
    r = spark.range(1).select(
        val.epoch_ms(F.lit(0), F.lit(1_700_000_000)).alias("a"), val.price_tick(F.lit(100.25)).alias("b"), val.price_tick(F.lit(0.0)).alias("c"),
        val.one_tick_spread(F.lit(1.25)).alias("d"), val.time_tag(F.lit(1_766_302_620_000)).alias("e"),
        bk.book_hash8(F.lit("1.0"), F.lit("2.0"), F.lit(None).cast("string"), F.lit("3.0")).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (1_700_000_000_000, 0.01, None, True, "20251221_0737")
    import hashlib

    assert r.f == hashlib.sha256(b"1.0:2.0:None:3.0").hexdigest()[:8]


def test_trades_go_to_the_first_block_at_or_after_them(spark):
    r = random.Random(21)
    times = sorted(r.sample(range(10, 400), 12))
    books = spark.createDataFrame([("Q", f"k{t}", t, 20.0, 5.0, 20.5, 3.0) for t in r.sample(times, 12)], BOOK)
    made = [(f"u{i}", r.randint(0, 420), r.choice(["buy", "sell"]), r.randint(1, 9)) for i in range(60)]
    trades = spark.createDataFrame([("Q", i, t, i, side, 20.25, float(n)) for i, t, side, n in made], TRADE)
    home = {i: next((b for b in times if b >= t), None) for i, t, _, _ in made}
    assert {x.trade_id: x.book_event_id for x in bl.bucket_trades(trades, books).collect()} == {i: f"k{b}" for i, b in home.items() if b is not None}
    for x in bl.blocks(books, trades).collect():
        own = [(n if side == "buy" else -n) for i, _, side, n in made if home[i] == x.block_ts_ms]
        assert x.n_trades == len(own) and (x.signed_volume or 0.0) == sum(own)


def test_features_of_books_with_and_without_trades(spark):
    books = spark.createDataFrame([("Q", "k1", 10, 49.5, 6.0, 50.5, 2.0), ("Q", "k2", 20, 49.0, 1.0, 49.5, 7.0), ("Q", "k3", 30, None, None, None, None)], BOOK)
    trades = spark.createDataFrame([("Q", "u1", 12, "1", "sell", 49.0, 4.0), ("Q", "u2", 17, "2", "buy", 49.75, 2.5), ("Q", "u3", 25, "3", "other", 48.0, 1.0)], TRADE)
    k = {x.book_event_id: x for x in bl.features(bl.blocks(books, trades)).collect()}
    assert (k["k1"].mid, k["k1"].spread, k["k1"].imbalance) == (50.0, 1.0, pytest.approx(0.5))
    weighed = (49.5 * 2 + 50.5 * 6) / 8
    assert (k["k1"].microprice, k["k1"].micro_pos) == (pytest.approx(weighed), pytest.approx(weighed - 50))
    assert k["k1"].missing_trades and k["k1"].missing_signed_volume
    assert (k["k2"].signed_volume, k["k2"].basis_bps) == (-1.5, pytest.approx((49.75 - 49.25) / 49.25 * 1e4))
    assert k["k3"].missing_mid and k["k3"].missing_basis_bps and k["k3"].signed_volume is None and k["k3"].signed_volume_lenient == 0.0


def test_what_lies_before_the_window_leaves_nothing(spark, many_chunks):
    schema = "symbol string, block_ts_ms bigint, book_event_id string, sv double"
    rows = spark.createDataFrame([("Q", 10, "a", 1e16), ("Q", 5000, "b", 1.0), ("Q", 5100, "c", 1.0)], schema)
    assert {x.book_event_id: x.w for x in bl.rolling_sum(rows, "sv", 1000, into="w").collect()} == {"a": 1e16, "b": 1.0, "c": 2.0}


def test_rolling_flow(spark, many_chunks):
    schema = "symbol string, block_ts_ms bigint, book_event_id string, sv double"
    rows = spark.createDataFrame([("Q", 300, "a", 2.5), ("Q", 450, "b", -4.0), ("Q", 900, "c", 0.25), ("Q", 900, "d", 8.0)], schema)
    got = {r.book_event_id: r.w for r in bl.rolling_sum(rows, "sv", 450, into="w").collect()}
    assert got == {"a": 2.5, "b": -1.5, "c": -3.75, "d": 4.25}


def test_nested_trades_are_cut_into_parts(spark, many_chunks):
    books = spark.createDataFrame([("S", "b", 100, 1.0, 1.0, 2.0, 1.0)], BOOK)
    trades = spark.createDataFrame([("S", f"{i:03d}", i % 7, str(i), "buy", 1.0, 1.0) for i in range(25)], TRADE)
    parts = bl.nested_trades(bl.bucket_trades(trades, books), size=10).orderBy("part").collect()
    assert [len(p.trade_bucket) for p in parts] == [10, 10, 5]
    flat = [(t.ts_ms, t.event_id) for p in parts for t in p.trade_bucket]
    assert flat == sorted(flat) and len(set(flat)) == 25
    clipped = bl.clip_bucket(bl.nested_trades(bl.bucket_trades(trades, books)), F.lit(3)).first()
    assert {t.ts_ms for t in clipped.trade_bucket} == {3, 4, 5, 6}


def test_market_state_forgets_after_a_gap(spark, many_chunks):
    books = spark.createDataFrame(
        [("S", "a", 0, 99.0, 1.0, 101.0, 1.0), ("S", "b", 10, 109.0, 1.0, 111.0, 1.0), ("S", "c", 30, 109.0, 1.0, 111.0, 2.0)], BOOK
    ).withColumnsRenamed({"ts_ms": "block_ts_ms", "event_id": "book_event_id"})
    r = {x.book_event_id: x for x in bl.market_state(books, reconnect_gap_ms=20).collect()}
    assert (r["a"].mid_ret, r["b"].mid_ret, r["c"].mid_ret) == (None, pytest.approx(0.1), None)
    assert (r["b"].reconnect, r["c"].reconnect) == (False, True)
    assert (r["a"].book_change, r["b"].top_px_change, r["c"].top_px_change, r["c"].book_change) == (False, True, False, True)


def test_raw_files_to_typed_events(spark, tmp_path):
    good = [
        {"channel": "l2Book", "symbol": "BTC", "recv_ts_ms": 5, "ts_ms": 4, "bids": [["1.5", "2"], ["1.6", "1"]], "asks": [["2", "3"]]},
        {"type": "l2Book", "symbol": "BTC", "recv_ts_ms": 5, "ts_ms": 9, "levels": [[{"px": "1", "sz": "1"}], [{"px": "2", "sz": "1"}]]},
        {"channel": "trades", "symbol": "BTC", "recv_ts_ms": 640, "ts_ms": 633, "px": "0.70", "sz": "12", "side": "sell", "trade_id": "n77", "event_id": "x"},
        {"channel": "trades", "symbol": "BTC", "recv_ts_ms": 655, "ts_ms": 633, "px": "0.70", "sz": "12", "side": "sell", "trade_id": "n77", "event_id": "y"},
        {"channel": "activeAssetCtx", "symbol": "BTC", "recv_ts_ms": 7, "status": "ok", "metadata": {"a": 1}},
    ]
    bad = [
        {"channel": "trades", "symbol": " ", "recv_ts_ms": 1, "ts_ms": 1, "px": "1", "sz": "1", "side": "buy", "trade_id": "t"},
        {"channel": "l2Book", "symbol": "BTC", "recv_ts_ms": 1, "ts_ms": 1, "bids": None, "asks": []},
        {"channel": "l2Book", "symbol": "BTC", "recv_ts_ms": 1, "ts_ms": 1, "bids": [["1", "2", "3"]], "asks": []},
        {"channel": "trades", "symbol": "BTC", "recv_ts_ms": 1, "ts_ms": 1, "px": "abc", "sz": "1", "side": "buy", "trade_id": "t"},
        {"channel": "nope", "symbol": "BTC", "recv_ts_ms": 1},
    ]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.jsonl").write_text("\n".join(json.dumps(x) for x in good) + "\n\n")
    with (tmp_path / "a" / "b" / "two.jsonl.zst").open("wb") as f:
        with zstandard.ZstdCompressor(write_content_size=False).stream_writer(f, closefd=False) as w:
            w.write("\n".join(json.dumps(x) for x in bad).encode())
    (tmp_path / "a" / "ignored.txt").write_text("{}")
    parsed = ev.parse_events(ev.read_raw(spark, str(tmp_path)))
    assert parsed.count() == 10
    errors = sorted(tuple(r.errors) for r in ev.quarantine(parsed).collect())
    assert errors == [("bids",), ("bids",), ("px",), ("symbol",), ("unknown_channel",)] or ("bids", "asks") in errors
    events = ev.dedupe(ev.valid(parsed))
    keys = {r.dedupe_key: r for r in events.collect()}
    assert set(keys) == {"BTC:n77:633", "l2Book:BTC:4", "l2Book:BTC:9", "activeAssetCtx:BTC:7"}
    assert keys["BTC:n77:633"].event_id == "x" and keys["BTC:n77:633"].px == Decimal("0.7")
    top = events.filter("dedupe_key = 'l2Book:BTC:4'").select(bk.book_top(F.col("bids"), F.col("asks")).alias("t")).first().t
    assert (top.bid_px, top.bid_sz, top.ask_px) == (Decimal("1.6"), Decimal("1"), Decimal("2"))
    out = str(tmp_path / "silver")
    ev.convert_raw(spark, str(tmp_path / "a" / "one.jsonl"), out)
    assert spark.read.parquet(out).count() == 4
    flat = ev.as_records(events.filter("event_type = 'trade'")).first()
    assert (flat.px, flat.sz) == ("0.7", "12")


def test_node_trades_and_candles(spark, tmp_path):
    hourly = tmp_path / "node_trades" / "hourly"
    hourly.mkdir(parents=True)
    rows = [{"coin": "ETH", "side": "B", "time": f"2024-01-01T00:{m:02d}:00.500", "px": str(100 + m), "sz": "1", "tid": m} for m in range(0, 60, 10)]
    with gzip.open(hourly / "0.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) for r in [*rows, {**rows[0], "coin": "BTC"}]))
    trades = ev.read_node_trades(spark, str(tmp_path), "ETH")
    bars = cd.ohlcv(trades, cd.interval_ms("15m")).orderBy("t").collect()
    assert [(b.o, b.h, b.l, b.c, b.v) for b in bars][0] == (Decimal(100), Decimal(110), Decimal(100), Decimal(110), Decimal(2))
    start = 1_704_067_200_000
    wire = [{"t": start + i * 900_000, "T": start + (i + 1) * 900_000 - 1, "s": "ETH", "i": "15m", "o": str(i), "c": str(i + 1), "h": str(i + 2), "l": str(i - 1), "v": "1.50", "n": 2} for i in range(3)]
    path = tmp_path / "candles.json"
    path.write_text(json.dumps(wire, indent=1))
    up = cd.roll_up(logs.read_candles(spark, str(path)), cd.interval_ms("45m")).first()
    assert (up.t, up.t_end, up.o, up.c, up.h, up.l, up.v, up.n) == (start, start + 2_699_999, 0, 3, 4, -1, Decimal("4.5"), 6)
    block = cd.to_blocks(logs.read_candles(spark, str(path)).orderBy("t").limit(1), 2.0, "15m").first()
    assert (block.block_ts_ms, block.book_event_id, block.bid_px) == (start + 899_999, f"candle:ETH:15m:{start}", pytest.approx(1 * (1 - 1e-4)))
    with pytest.raises(ValueError):
        cd.interval_ms("3w")
    sinks.write_candles(logs.read_candles(spark, str(path)), str(tmp_path / "out"), "15m")
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text)[0] == {"t": start, "T": start + 899_999, "s": "ETH", "i": "15m", "o": "0", "c": "1", "h": "2", "l": "-1", "v": "1.5", "n": 2}


def zst_file(lines, frame_bytes, known_size):
    """Frames cut anywhere, also inside lines and characters, with or without their size in the header, and a skippable frame."""
    text = "\n".join(lines).encode()
    out = b"\x50\x2a\x4d\x18" + (5).to_bytes(4, "little") + b"extra"
    for at in range(0, len(text), frame_bytes):
        out += zstandard.ZstdCompressor(write_content_size=known_size, write_checksum=at % 2 == 0).compress(text[at : at + frame_bytes])
    return out


@pytest.mark.parametrize("known_size", [True, False])
def test_zst_files_are_split_by_frames(spark, tmp_path, monkeypatch, known_size):
    lines = [f'{{"channel": "trades", "recv_ts_ms": {i}, "symbol": "é{"x" * (i * 37 % 900)}"}}' for i in range(200)]
    monkeypatch.setattr(zst, "STEP_BYTES", 64)
    for n, (frame, part) in enumerate([(10, 1), (333, 500), (5000, 100), (10**6, 1), (1000, 10**6)]):
        data = zst_file(lines if n % 2 else [*lines, ""], frame, known_size)
        own = zst.parts(memoryview(data), part)
        assert b"".join(own) == data and (len(own) > 10) == (n in (0, 1, 2))
        got = [x.decode() for i, p in enumerate(own) for some in zst.lines(p, i == 0, zst.first_line(own[i + 1 :])) for x in some if x]
        assert got == lines
    for n in range(3):
        (tmp_path / f"{n}.jsonl.zst").write_bytes(zst_file(lines, 700, known_size))
    (tmp_path / "empty.zst").write_bytes(b"")
    (tmp_path / "tiny.zst").write_bytes(zst_file(['{"channel": "bbo", "recv_ts_ms": 7}'], 10**6, known_size))
    (tmp_path / "cut.zst").write_bytes(zst_file(lines[:3], 10**6, known_size)[:-9])
    packed = spark.read.format("binaryFile").load(str(tmp_path))
    assert zst.read_lines(packed, 1000).filter("value like '{%' and not source_file like '%cut.zst'").count() == 601
    rows = ev.read_raw(spark, str(tmp_path)).collect()
    bad = [r for r in rows if r._corrupt is not None]
    assert {r.source_file.rsplit("/", 1)[-1] for r in bad} == {"cut.zst"}
    assert sorted(r.recv_ts_ms for r in rows if r.channel == "trades" and "cut" not in r.source_file) == sorted([*range(200)] * 3)
