"""Streams of market events. Each takes and returns a streaming DataFrame; sources and sinks are the caller's.

The event time column is a TIMESTAMP made from ``ts_ms``. State is bounded by the watermark, and a micro-batch by
``maxFilesPerTrigger`` of the source. Operators whose state is a table are handlers of micro-batches, in ``state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.sources import events as ev
from tideblock.sources.schemas import RAW_EVENT
from tideblock.sources.zst import read_lines
from tideblock.streaming.state import Dedupe

# Names under which a fill may carry its id.
FILL_ID_FIELDS = ["tid", "tradeId", "hash"]


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000, pattern: str = ev.PLAIN_FILES, zst: str | None = None) -> DataFrame:
    """Appended event files as a stream of raw lines; with ``zst`` also files of that pattern, split by frames."""
    found = lambda kind: kind.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    plain = found(spark.readStream.schema(RAW_EVENT).options(**ev.CORRUPT)).option("pathGlobFilter", pattern).json(path)
    if zst is None:
        return plain
    packed = found(spark.readStream.format("binaryFile")).option("pathGlobFilter", zst).load(path)
    return plain.unionByName(ev.parse_lines(read_lines(packed)).drop("source_file"))


def ingest(raw: DataFrame) -> DataFrame:
    """Valid typed events of a raw stream."""
    return ev.valid(ev.parse_events(raw))


def event_timed(rows: DataFrame, delay: str, at: str = "ts_ms", into: str = "event_time") -> DataFrame:
    """Adds the event time and its watermark."""
    return rows.withColumn(into, F.timestamp_millis(F.col(at).cast("bigint"))).withWatermark(into, delay)


def with_fill_id(fills: DataFrame, start_ms: int) -> DataFrame:
    """Fills at or after the run's start with their ``fill_id``, null where no id field is set."""
    ids = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in FILL_ID_FIELDS if c in fills.columns])
    return fills.withColumn("fill_id", ids).filter(F.col("ts_ms") >= start_ms)


def dedupe_trades(spark: SparkSession, path: str, delay_ms: int) -> Dedupe:
    """First row per (symbol, trade id) within the delay; a handler of micro-batches."""
    return Dedupe(spark, path, ["symbol", "trade_id"], ["ts_ms", "event_id"], delay_ms)


def dedupe_fills(spark: SparkSession, path: str, delay_ms: int, order: list[str]) -> Dedupe:
    """First row per run and fill id (see :func:`with_fill_id`) within the delay; rows without an id are set apart."""
    return Dedupe(spark, path, ["run_id", "fill_id"], order, delay_ms)


def ohlcv(trades: DataFrame, length: str, delay: str) -> DataFrame:
    """Bars, each emitted once, when the watermark passes its end."""
    position = F.struct("ts_ms", "event_id")
    return (
        event_timed(trades, delay)
        .groupBy("symbol", F.window("event_time", length).alias("bar"))
        .agg(
            F.min_by("px", position).alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", position).alias("c"),
            F.sum("sz").alias("v"), F.count(F.lit(1)).alias("n"),
        )
        .select("symbol", F.unix_millis("bar.start").alias("t"), "o", "h", "l", "c", "v", "n")
    )


def sliding_flow(trades: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    """Signed volume of sliding windows."""
    signed = F.when(F.col("side") == "buy", F.col("sz")).otherwise(-F.col("sz"))
    return (
        event_timed(trades, delay)
        .groupBy("symbol", F.window("event_time", length, slide).alias("w"))
        .agg(F.sum(signed).alias("signed_volume"))
        .select("symbol", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "signed_volume")
    )


def session_gaps(rows: DataFrame, gap_ms: int, delay: str) -> DataFrame:
    """Connectivity sessions: a gap of at least ``gap_ms`` starts a new one."""
    return (
        event_timed(rows, delay)
        .groupBy("symbol", F.session_window("event_time", f"{gap_ms - 1} milliseconds").alias("s"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))
        .select("symbol", F.unix_millis("s.start").alias("start_ms"), "last_ms", "n")
    )


def fill_gate(fills: DataFrame, min_fills: int, min_notional: float) -> DataFrame:
    """Running count and notional of valid fills per run, and whether both thresholds are met (update or complete mode)."""
    ok = fills.filter(F.col("px").isNotNull() & (F.col("sz") > 0))
    out = ok.groupBy("run_id").agg(F.count(F.lit(1)).alias("fills"), F.sum(F.col("px") * F.col("sz")).alias("notional"))
    return out.withColumn("reached", (F.col("fills") >= min_fills) & (F.col("notional") >= min_notional))
