"""Running values over long ordered series, without one task per key.

A key may hold a third of all rows, so no window here is partitioned by the key alone. Rows are range-partitioned
by (key, order) into chunks; the chunk number is written with the row. Each chunk is summarised, the summaries
(one row per key and chunk) are scanned, and the result enters its chunk as one extra row before (or after) the
chunk's own rows. The row-level window is partitioned by (key, chunk).

Beyond sums and last values, :func:`fold` runs any associative operation (composed maps, merged lists) the same way,
with doubling steps instead of a built-in window function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideblock import scratch

CHUNK = "_chunk"
_SLOT = "_slot"
FOLD_BLOCK = 256
_OPEN, _CLOSE = Window.unboundedPreceding, Window.currentRow


@dataclass(frozen=True)
class Run:
    kind: str
    value: Column


def running_sum(value: Column) -> Run:
    return Run("sum", value)


def running_max(value: Column) -> Run:
    return Run("max", value)


def running_min(value: Column) -> Run:
    return Run("min", value)


def last_seen(value: Column) -> Run:
    """Last non-null value up to and including this row."""
    return Run("last", value)


def last_before(value: Column) -> Run:
    """Last non-null value of the rows before this one."""
    return Run("last_before", value)


def previous(value: Column) -> Run:
    """Value of the row before, null or not."""
    return Run("previous", value)


def following(value: Column) -> Run:
    """Value of the row after, null or not."""
    return Run("following", value)


def row_count() -> Run:
    return Run("sum", F.lit(1).cast("bigint"))


def chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Split every key's series into contiguous chunks of similar size.

    ``order`` must end in a column that makes rows unique, so that even one instant can be split. The number of
    chunks is ``spark.tideblock.chunks`` where set, else the session's shuffle partitions (merged when small).
    """
    by = [F.col(c) for c in [*keys, *order]]
    wanted = df.sparkSession.conf.get("spark.tideblock.chunks", None)
    ranged = df.repartitionByRange(int(wanted), *by) if wanted else df.repartitionByRange(*by)
    return scratch.keep(ranged.withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _summary(run: Run, column: Column, position: Column) -> Column:
    if run.kind in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](column)
    if run.kind in ("last", "last_before"):
        return F.max_by(column, F.when(column.isNotNull(), position))
    if run.kind == "previous":
        return F.max_by(column, position)
    return F.min_by(column, position)


def _carry(run: Run, column: Column, by_key) -> Column:
    earlier = by_key.rowsBetween(_OPEN, -1)
    if run.kind in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](column).over(earlier)
    if run.kind in ("last", "last_before"):
        return F.last(column, ignorenulls=True).over(earlier)
    if run.kind == "previous":
        return F.lag(column).over(by_key)
    return F.lead(column).over(by_key)


def _in_chunk(run: Run, column: Column, rows) -> Column:
    upto = rows.rowsBetween(_OPEN, _CLOSE)
    if run.kind in ("sum", "max", "min"):
        return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](column).over(upto)
    if run.kind == "last":
        return F.last(column, ignorenulls=True).over(upto)
    if run.kind == "last_before":
        return F.last(column, ignorenulls=True).over(rows.rowsBetween(_OPEN, -1))
    if run.kind == "previous":
        return F.lag(column).over(rows)
    return F.lead(column).over(rows)


def scan(chunks: DataFrame, keys: Sequence[str], order: Sequence[str], **runs: Run) -> DataFrame:
    """Add one column per run to a chunked frame. ``keys`` may refine the keys it was chunked by."""
    position = F.struct(*[F.col(c) for c in order])
    names = {name: f"_v_{name}" for name in runs}
    data = chunks.withColumns({names[n]: r.value for n, r in runs.items()})
    place = [*keys, CHUNK]
    summary = data.groupBy(*place).agg(
        *[_summary(r, F.col(names[n]), position).alias(names[n]) for n, r in runs.items()]
    )
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = summary.select(*place, *[_carry(r, F.col(names[n]), by_key).alias(names[n]) for n, r in runs.items()])
    before = [n for n, r in runs.items() if r.kind != "following"]
    after = [n for n, r in runs.items() if r.kind == "following"]
    rows = data.withColumn(_SLOT, F.lit(1))
    if before:
        head = carried.select(*place, *[names[n] for n in before], F.lit(0).alias(_SLOT))
        rows = rows.unionByName(head, allowMissingColumns=True)
    if after:
        tail = carried.select(*place, *[names[n] for n in after], F.lit(2).alias(_SLOT))
        rows = rows.unionByName(tail, allowMissingColumns=True)
    series = Window.partitionBy(*place).orderBy(_SLOT, *order)
    out = rows.withColumns({n: _in_chunk(r, F.col(names[n]), series) for n, r in runs.items()})
    return out.filter(F.col(_SLOT) == 1).drop(_SLOT, *names.values())


def over(df: DataFrame, keys: Sequence[str], order: Sequence[str], **runs: Run) -> DataFrame:
    """Chunk, scan and drop the chunk number."""
    return scan(chunk(df, keys, order), keys, order, **runs).drop(CHUNK)


def _doubled(rows: DataFrame, column: str, merge: Callable[[Column, Column], Column], series, longest: int, start: Column | None = None) -> DataFrame:
    """Running results over ``series``: each step merges in the result that ends where this one begins, twice as far back as the step before.

    ``longest`` bounds the rows of a series; a row's ``start`` is its number of rows since its own beginning, where that isn't the series'.
    """
    back = 1
    while back < longest:
        earlier = F.lag(column, back).over(series)
        reached = earlier.isNotNull() if start is None else (start >= back)
        rows = rows.withColumn("_earlier", F.when(reached, earlier))
        rows = rows.withColumn(column, F.when(F.col("_earlier").isNull(), F.col(column)).otherwise(merge(F.col("_earlier"), F.col(column))))
        back *= 2
    return rows.drop("_earlier")


def fold(
    chunks: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, value: Column, merge: Callable[[Column, Column], Column],
    block: int | None = None,
) -> DataFrame:
    """Add the running result of an associative operation to a chunked frame: ``value`` of all rows up to this one, merged.

    ``merge(earlier, later)`` combines two neighbouring stretches; ``value`` and what it gives must not be null, and keys neither. Rows are
    merged by doubling within blocks of ``block`` rows of their chunk; the blocks' results, a few rows of the chunk, are merged
    likewise within the chunk, the chunks' results within the key, and what lies before a block joins its rows.
    """
    block = block or FOLD_BLOCK
    place = [*keys, CHUNK]
    series = Window.partitionBy(*place).orderBy(*order)
    rows = chunks.withColumns({"_at": F.row_number().over(series) - 1, "_last": F.lead(F.lit(1)).over(series).isNull(), into: value})
    rows = _doubled(rows, into, merge, series, block, F.col("_at") % block)
    rows = scratch.keep(rows.withColumn("_block", F.floor(F.col("_at") / block)), "fold")
    most, chunk_count = rows.agg(F.max("_block"), F.max(CHUNK)).first()
    if most is None:
        return rows.drop("_at", "_last", "_block")
    ends = rows.filter(F.col("_last") | (F.col("_at") % block == block - 1)).select(*place, "_block", "_last", into)
    in_chunk = Window.partitionBy(*place).orderBy("_block")
    ends = _doubled(ends, into, merge, in_chunk, most + 1)
    ends = scratch.keep(ends.withColumn("_before", F.lag(into).over(in_chunk)), "fold")
    in_key = Window.partitionBy(*keys).orderBy(CHUNK)
    whole = _doubled(ends.filter("_last").select(*place, into), into, merge, in_key, chunk_count + 1)
    whole = whole.select(*place, F.lag(into).over(in_key).alias("_open"))
    before = F.when(F.col("_open").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_open")).otherwise(merge(F.col("_open"), F.col("_before")))
    heads = ends.join(whole, place).select(*place, "_block", before.alias("_head")).filter(F.col("_head").isNotNull())
    out = rows.join(heads, [*place, "_block"], "left")
    result = F.when(F.col("_head").isNull(), F.col(into)).otherwise(merge(F.col("_head"), F.col(into)))
    return out.withColumn(into, result).drop("_at", "_last", "_block", "_head")
