"""Run logs, run metrics, run reports, candles and account states as tables keyed by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.functions import values as val
from tideblock.operators.candles import interval_ms_of
from tideblock.sources.schemas import ACCOUNT_STATE, CANDLE, METRICS, RUN_LOGS, RUN_REPORT


def _parent(path: Column) -> Column:
    """Name of the folder; of a partition folder ``key=value`` the value."""
    return F.url_decode(F.regexp_extract(path, r"([^/=]+)/[^/]+$", 1))


def _first_filled(*columns: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def read_run_log(spark: SparkSession, root: str, name: str, strict: bool = False, pattern: str | None = None) -> DataFrame:
    """One log of every run below ``root``; ``run_id`` is the folder name (or that of a partition folder ``run_id=...``).

    Bad lines are skipped, or raise when ``strict``. Runs without the file contribute no rows. ``seq`` orders the
    lines of a file by their place in it.
    """
    found = (
        spark.read.schema(RUN_LOGS[name])
        .option("mode", "FAILFAST" if strict else "DROPMALFORMED")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern or f"{name}.jsonl*")
        .json(root)
    )
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = found.select("*", _parent(F.col("_metadata.file_path")).alias("run_id"), place.alias("seq"))
    if name == "orders":
        rows = rows.withColumn("client_oid", _first_filled("client_oid", "cloid", "clientOid"))
    if name == "fills":
        rows = rows.withColumn("cloid", _first_filled("cloid", "client_oid", "clientOid"))
    if name == "market_state":
        rows = rows.withColumn("mark_px", F.coalesce("mark_px", "markPx"))
    return rows


def read_metrics(spark: SparkSession, root: str, pattern: str = "metrics.json") -> DataFrame:
    """``metrics.json`` of every run below ``root``; nested values by dotted path."""
    rows = (
        spark.read.schema(METRICS).option("multiLine", "true").option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
    )
    return rows.select(_parent(F.col("_metadata.file_path")).alias("run_id"), "*")


def read_run_reports(spark: SparkSession, root: str, pattern: str = "run_report.json") -> DataFrame:
    """``run_report.json`` of every run folder; the root's own and ``_monitor`` folders are left out."""
    top = root.rstrip("/").rsplit("/", 1)[-1]
    rows = (
        spark.read.schema(RUN_REPORT).option("multiLine", "true").option("mode", "DROPMALFORMED")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(root)
        .select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
    )
    folder = _parent(F.col("path"))
    return rows.filter(~F.col("path").contains("/_monitor/") & (folder != top)).select(
        F.coalesce(
            F.nullif("run_id", F.lit("")), F.nullif(F.regexp_extract("run_dir", r"([^/\\]+)[/\\]*$", 1), F.lit("")), folder
        ).alias("run_id"),
        "mtime", "path", "fills_count", "notional_sum", "fills_joined_count", "taker_guard_trip", "taker_notional_share",
        F.col("net_bps.median").alias("net_med"), F.col("net_bps.p10").alias("net_p10"),
        F.try_element_at("markout_bps", F.lit("30"))["median"].alias("markout30_med"),
    )


def read_candles(spark: SparkSession, path: str, one_array_per_file: bool = True) -> DataFrame:
    """JSON arrays of candles, one per file or one per line; prices and volume as decimals."""
    rows = spark.read.schema(CANDLE).option("multiLine", str(one_array_per_file).lower()).option("recursiveFileLookup", "true").json(path)
    numbers = {c: val.to_decimal(F.col(c)) for c in ("o", "c", "h", "l", "v")}
    ends = F.col("t") + interval_ms_of(F.col("i")) - 1
    return rows.withColumns(numbers).withColumn("t_end", ends).withColumnRenamed("s", "symbol")


def read_account_states(spark: SparkSession, path: str) -> DataFrame:
    """Captured account states in the flat form of ``runlogs.account_state``."""
    rows = spark.read.schema(ACCOUNT_STATE).option("mode", "DROPMALFORMED").json(path)
    part = lambda c: F.struct(
        *[
            val.to_double(F.col(f"{c}.{a}")).alias(b)
            for a, b in (
                ("accountValue", "account_value"), ("totalMarginUsed", "total_margin_used"),
                ("totalNtlPos", "total_ntl_pos"), ("totalRawUsd", "total_raw_usd"),
            )
        ]
    )
    held = F.transform(
        "assetPositions",
        lambda p: F.struct(
            val.canonical_symbol(p["position"]["coin"]).alias("coin"),
            val.to_double(p["position"]["szi"]).alias("szi"),
            val.to_double(p["position"]["entryPx"]).alias("entry_px"),
        ),
    )
    return rows.select(
        "ts_ms", part("marginSummary").alias("margin_summary"), part("crossMarginSummary").alias("cross_summary"),
        val.to_double(F.col("withdrawable")).alias("withdrawable"), held.alias("positions"),
    )


def metric_at(path: str) -> Column:
    """A metric by dotted path, as double."""
    return F.col(path).cast("double")
