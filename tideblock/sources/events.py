"""Raw market events: JSON lines to typed, validated, deduplicated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.functions import values as val
from tideblock.sources.schemas import NODE_TRADE, RAW_EVENT
from tideblock.sources.sinks import write_table
from tideblock.sources.zst import read_lines

# Channel names and the event type of each.
CHANNELS = {
    "l2Book": "book",
    "bbo": "bbo",
    "trades": "trade",
    "activeAssetCtx": "asset_ctx",
    "userFills": "user_fill",
    "userFundings": "user_funding",
}
# Fields each channel must carry, by kind.
NEEDS_TIME = ["l2Book", "trades", "userFills", "userFundings"]
NEEDS_TEXT = {"side": ["trades", "userFills"], "trade_id": ["trades", "userFills"], "status": ["activeAssetCtx"], "funding_id": ["userFundings"]}
NEEDS_NUMBER = {
    "px": ["trades", "userFills"], "sz": ["trades", "userFills"], "fee": ["userFills"], "amount": ["userFundings"], "rate": ["userFundings"],
    "bid_px": ["bbo"], "bid_sz": ["bbo"], "ask_px": ["bbo"], "ask_sz": ["bbo"],
}
PLAIN_FILES, ZST_FILES = "*.jsonl", "*.zst"
CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_lines(lines: DataFrame) -> DataFrame:
    """Raw events of (source_file, value) text lines; a line that is no event is kept in ``_corrupt``."""
    parsed = lines.select(F.from_json("value", RAW_EVENT, CORRUPT).alias("_e"), "source_file")
    return parsed.select("_e.*", "source_file")


def read_raw(spark: SparkSession, path: str, pattern: str = PLAIN_FILES, zst: str | None = ZST_FILES) -> DataFrame:
    """Every JSON line below ``path`` with its file: files of ``pattern``, plain or .gz, and .zst files, which are split by frames.

    A .gz file is one task however large it is, so rows are spread out after the scan by the next shuffle (deduplication hashes them by key).
    """
    found = lambda kind: kind.option("recursiveFileLookup", "true")
    plain = found(spark.read.schema(RAW_EVENT).options(**CORRUPT)).option("pathGlobFilter", pattern).json(path)
    rows = plain.select("*", F.col("_metadata.file_path").alias("source_file"))
    if zst is None:
        return rows
    packed = found(spark.read.format("binaryFile")).option("pathGlobFilter", zst).load(path)
    return rows.unionByName(parse_lines(read_lines(packed)))


def _levels(side: str, place: int) -> Column:
    """Levels from ``bids``/``asks`` pairs, or from the two-array ``levels`` form."""
    pairs = F.transform(
        F.col(side), lambda x: F.struct(val.to_decimal(F.get(x, 0)).alias("px"), val.to_decimal(F.get(x, 1)).alias("sz"))
    )
    named = F.transform(
        F.get(F.col("levels"), place),
        lambda x: F.struct(val.to_decimal(x["px"]).alias("px"), val.to_decimal(x["sz"]).alias("sz")),
    )
    return F.coalesce(F.when(F.size("levels") == 2, named), pairs)


def book_levels(side: str, depth: int | None = None) -> Column:
    """Parsed levels of a wire book, cut to ``depth``."""
    parsed = _levels(side, 0 if side == "bids" else 1)
    return parsed if depth is None else F.slice(parsed, 1, depth)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def parse_events(raw: DataFrame) -> DataFrame:
    """Typed columns of all channels with ``is_valid`` and ``errors``."""
    channel = F.coalesce(F.nullif("channel", F.lit("")), F.nullif("type", F.lit("")))
    # Numbers and levels are parsed once, here; the checks below only look at the results.
    rows = raw.withColumns(
        {
            "_c": channel,
            "_pairs": F.exists("bids", lambda x: F.size(x) != 2) | F.exists("asks", lambda x: F.size(x) != 2),
            "bids": book_levels("bids"),
            "asks": book_levels("asks"),
            **{c: val.to_decimal(F.col(c)) for c in NEEDS_NUMBER},
            **{c: F.trim(c) for c in ("symbol", *NEEDS_TEXT)},
        }
    )
    on = lambda names: F.coalesce(F.col("_c").isin(names), F.lit(False))
    problems = [
        (F.col("_corrupt").isNotNull(), "corrupt"),
        (F.col("_c").isNull(), "missing_channel"),
        (F.col("_c").isNotNull() & ~on(list(CHANNELS)), "unknown_channel"),
        (F.col("recv_ts_ms").isNull(), "recv_ts_ms"),
        (_blank(F.col("symbol")), "symbol"),
        (on(NEEDS_TIME) & F.col("ts_ms").isNull(), "ts_ms"),
    ]
    problems += [(on(names) & _blank(F.col(c)), c) for c, names in NEEDS_TEXT.items()]
    problems += [(on(names) & F.col(c).isNull(), c) for c, names in NEEDS_NUMBER.items()]
    for side in ("bids", "asks"):
        broken = F.exists(side, lambda x: x["px"].isNull() | x["sz"].isNull()) | F.col("_pairs")
        problems.append((on(["l2Book"]) & (F.col(side).isNull() | F.coalesce(broken, F.lit(False))), side))
    errors = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in problems]), lambda e: e.isNotNull())
    kind = F.lit(None).cast("string")
    for name, event_type in CHANNELS.items():
        kind = F.when(F.col("_c") == name, F.lit(event_type)).otherwise(kind)
    event_id = val.event_id(F.col("event_id"), F.col("_c"), F.col("symbol"), F.col("ts_ms"), F.col("recv_ts_ms"))
    # ``line`` is the place in the scan, and settles which of two equal arrivals came first. Being non-deterministic
    # it also keeps the validity filter above this projection: pushed below, the optimizer derives constraints over
    # every combination of the parsed columns, which can take minutes.
    place = {} if raw.isStreaming else {"line": F.monotonically_increasing_id()}
    typed = rows.withColumns({"errors": errors, "event_type": kind, "event_id": event_id, **place})
    trade_key = F.concat_ws(":", "symbol", "trade_id", F.col("ts_ms").cast("string"))
    return typed.withColumns(
        {
            "is_valid": F.size("errors") == 0,
            "dedupe_key": F.when(F.col("event_type") == "trade", trade_key).otherwise(F.col("event_id")),
        }
    ).drop("_c", "_pairs", "channel", "type", "levels")


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_valid").drop("is_valid", "errors", "_corrupt")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("is_valid"))


def dedupe(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First row per dedupe key, by arrival, file and id.

    An aggregate, not a window: copies are reduced before the shuffle, so a key copied very often stays cheap. Rows of a scan are spread by
    their place first: a file that can't be split is one task, and the aggregate would sort all of it there.
    """
    keys = keys or ["dedupe_key"]
    if "line" in events.columns:
        events = events.repartition("line")
    by = [c for c in ("recv_ts_ms", "source_file", "line", "event_id") if c in events.columns]
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return first.select(*keys, "_r.*").select(*events.columns)


def as_records(events: DataFrame) -> DataFrame:
    """Flat export form: decimals as plain text."""
    text = {
        f.name: val.decimal_text(F.col(f.name), strip_zeros=True) for f in events.schema.fields if f.dataType.typeName() == "decimal"
    }
    return events.withColumns(text)


def filter_symbol(events: DataFrame, symbol: str) -> DataFrame:
    """Events whose canonical symbol is that of ``symbol``."""
    return events.filter(val.canonical_symbol(F.col("symbol")) == val.canonical_symbol(F.lit(symbol)))


def convert_raw(spark: SparkSession, raw_path: str, out_path: str, *pattern: str | None) -> None:
    """Raw lines to deduplicated Parquet, by event type and symbol. ``pattern`` is that of :func:`read_raw`."""
    events = dedupe(valid(parse_events(read_raw(spark, raw_path, *pattern))))
    write_table(events, out_path, ["event_type", "symbol"])


def read_node_trades(spark: SparkSession, path: str, coin: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Trades of one coin from hourly node files (plain or gzip), optionally within [start, end]."""
    raw = (
        spark.read.schema(NODE_TRADE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").json(path)
    )
    t = F.coalesce(F.col("time").try_cast("bigint"), val.micros_to_ms(F.try_to_timestamp("time")))
    rows = raw.filter(F.col("coin") == coin).select(
        F.col("coin").alias("symbol"), t.alias("ts_ms"), F.col("tid").alias("event_id"),
        val.normalize_side(F.col("side")).alias("side"), val.to_decimal(F.col("px")).alias("px"), val.to_decimal(F.col("sz")).alias("sz"),
    )
    if start_ms is not None:
        rows = rows.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        rows = rows.filter(F.col("ts_ms") <= end_ms)
    return rows
