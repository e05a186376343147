"""Writers. Tables go to Parquet, partitioned so that later scans prune; JSON and TSV only at the edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.functions.values import decimal_text


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd. With partition values, rows are rebalanced by them: few files for each, and adaptive execution splits large ones."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_dated(df: DataFrame, path: str, keys: Sequence[str], at: str = "ts_ms") -> None:
    """Parquet by keys and UTC date."""
    dated = df.withColumn("date", F.to_date(F.timestamp_millis(F.col(at).cast("bigint"))))
    write_table(dated, path, [*keys, "date"])


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, order: Sequence[str]) -> None:
    """A table bucketed and sorted by key, for joins and grouping by that key without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_candles(bars: DataFrame, path: str, interval: str) -> None:
    """Candles in wire form, decimals as text without trailing zeros: one array per line, of a symbol's UTC day."""
    text = lambda c: decimal_text(F.col(c).cast("decimal(38,18)"), strip_zeros=True).alias(c)
    wire = F.struct(
        "t", F.col("t_end").alias("T"), F.col("symbol").alias("s"), F.lit(interval).alias("i"), *[text(c) for c in ("o", "c", "h", "l", "v")], "n"
    )
    day = F.floor(F.col("t") / F.lit(86_400_000))
    arrays = bars.select("symbol", day.alias("day"), "t", wire.alias("w")).groupBy("symbol", "day").agg(
        F.sort_array(F.collect_list(F.struct("t", "w"))).alias("a")
    )
    text_rows = arrays.select(F.to_json(F.transform("a", lambda x: x["w"])).alias("value"))
    text_rows.write.mode("overwrite").text(path)
