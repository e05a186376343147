"""Running streams to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideblock import scratch

BATCH_ROWS = 5_000_000
LEAST_SLICES = 3


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, appending to a Parquet table, and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived, one call per micro-batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def collect_stream(stream: DataFrame) -> DataFrame:
    """Run an append stream over what has arrived and return its table."""
    spark = stream.sparkSession
    path = scratch.new_path(spark, "stream")
    to_parquet(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def flush_row(df: DataFrame, at: str, after_ms: int, **values: object) -> DataFrame:
    """A row that moves the watermark past all others: ``after_ms`` later than the latest, with ``values`` and else nulls.

    Give values to the keys of a join, as rows with null keys are dropped before they move its watermark.
    """
    last = df.agg((F.max(at) + F.lit(after_ms)).alias(at))
    return last.select(*[(F.col(at) if f.name == at else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in df.schema.fields]).filter(F.col(at).isNotNull())


def _feed(df: DataFrame, at: str, start: Callable[[DataFrame, str], StreamingQuery], rows_per_batch: int, flush_ms: int | None) -> str:
    """Append a table to a stream's input in time order, slice by slice, each processed before the next comes. Returns the folder.

    Slices hold about ``rows_per_batch`` rows, with ``LEAST_SLICES`` of them at least, so that state always crosses batches.
    """
    spark = df.sparkSession
    path = scratch.new_path(spark, "replay")
    count = df.count()
    slices = max(LEAST_SLICES, -(-count // rows_per_batch))
    cuts = sorted(set(df.approxQuantile(at, [i / slices for i in range(1, slices)], 0.2 / slices))) if count else []
    edges = list(zip([None, *cuts], [*cuts, None], strict=True))
    low = lambda a: F.lit(True) if a is None else F.col(at) >= F.lit(int(a))
    high = lambda b: F.lit(True) if b is None else F.col(at) < F.lit(int(b))
    parts = [df.filter(low(a) & high(b)) for a, b in edges] + ([] if flush_ms is None else [flush_row(df, at, flush_ms)])
    for part in parts:  # a stream that runs while files arrive could see half a slice, and the rest would be late
        part.write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(df.schema).parquet(f"{path}/in"), path).awaitTermination()
    return path


def replay(df: DataFrame, at: str, build: Callable[[DataFrame], DataFrame], flush_ms: int | None = None, rows_per_batch: int = BATCH_ROWS) -> DataFrame:
    """The output of a stream over a table that arrives in time order.

    With ``flush_ms`` a last row closes what the watermark still holds open.
    """
    schema = None

    def start(stream: DataFrame, path: str) -> StreamingQuery:
        nonlocal schema
        out = build(stream)
        schema = out.schema
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    path = _feed(df, at, start, rows_per_batch, flush_ms)
    return df.sparkSession.read.schema(schema).parquet(f"{path}/out")


def replay_into(df: DataFrame, at: str, handle: Callable[[DataFrame, int], None], flush_ms: int | None = None, rows_per_batch: int = BATCH_ROWS) -> None:
    """Give a table to a handler of micro-batches in time order."""

    def start(stream: DataFrame, path: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    _feed(df, at, start, rows_per_batch, flush_ms)


def last_complete(stream: DataFrame) -> DataFrame:
    """Run a complete-mode aggregation over what has arrived and return its final table.

    Each micro-batch writes its own folder, so a repeated batch overwrites itself.
    """
    spark = stream.sparkSession
    path = scratch.new_path(spark, "stream")
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{batch_id}")
        seen.append(batch_id)

    each_batch(stream, write, f"{path}/checkpoint", "complete")
    return spark.read.schema(stream.schema).parquet(f"{path}/out/{max(seen)}")
