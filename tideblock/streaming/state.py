"""Stateful micro-batches over stored tables, for operators whose state is itself a table.

Each handler is given to ``foreachBatch``. A micro-batch reads the version of its state tables that the batch before wrote, and writes
its results and the next version under its own batch id. A batch that Spark repeats after a failure reads the same version and
writes the same folders again, so its rows count once. State is partitioned like any table: a busy symbol is split over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideblock.operators import blocks as bl
from tideblock.operators import gates
from tideblock.operators.asof import asof


class Stored:
    """Tables of a stream, one folder per table and batch id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def store(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        where = f"{self.path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def before(self, name: str, batch_id: int, like: DataFrame) -> DataFrame:
        """The version that the batch before wrote; at first an empty table with the columns of ``like``."""
        if batch_id == 0:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}/batch={batch_id - 1}")

    def emitted(self, name: str, schema: str | None = None) -> DataFrame:
        """All that batches have written so far to a result table; with a schema an empty one before the first."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], schema)
        return rows.drop("batch")

    def clock(self, batch: DataFrame, at: str, delay_ms: int, batch_id: int) -> tuple[int | None, int | None]:
        """(old, new) watermark: the latest time of all batches before this one, and with it, less the delay."""
        now = batch.agg(F.max(F.col(at).cast("bigint")).alias("latest"))
        earlier = self.before("clock", batch_id, now)
        old = earlier.agg(F.max("latest")).first()[0]
        new = self.store(now.unionByName(earlier).agg(F.max("latest").alias("latest")), "clock", batch_id).first()[0]
        return old if old is None else old - delay_ms, new if new is None else new - delay_ms


def _not_before(at: str, mark: int | None) -> Column:
    """Whether a row is on time; before the first watermark all are."""
    return F.lit(True) if mark is None else F.col(at) >= mark


class Dedupe(Stored):
    """First row of each key among those that come within ``delay_ms`` of event time.

    Results are in ``rows``. Rows without a key are in ``without_key``, rows behind the watermark in ``late``; neither is lost. Of equal
    keys in one batch the first by ``order`` stays. Keys are kept until the watermark has passed them by the delay.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], delay_ms: int, at: str = "ts_ms") -> None:
        super().__init__(spark, path)
        self.keys, self.order, self.delay_ms, self.at = list(keys), list(order), delay_ms, at

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        batch = self.store(batch, "batch", batch_id)
        old, new = self.clock(batch, self.at, self.delay_ms, batch_id)
        named = F.lit(True)
        for k in self.keys:
            named = named & F.col(k).isNotNull()
        self.store(batch.filter(~named & F.col(self.at).isNotNull()), "without_key", batch_id)
        on_time = F.coalesce(_not_before(self.at, old), F.lit(False))
        self.store(batch.filter(named & ~on_time), "late", batch_id)
        seen = self.before("seen", batch_id, batch.select(*self.keys, self.at))
        rest = [c for c in batch.columns if c not in self.keys]
        first = batch.filter(named & on_time).groupBy(*self.keys).agg(F.min_by(F.struct(*rest), F.struct(*self.order)).alias("_row"))
        fresh = first.select(*self.keys, "_row.*").select(*batch.columns).join(seen.select(*self.keys), self.keys, "left_anti")
        rows = self.store(fresh, "rows", batch_id)
        known = seen.unionByName(rows.select(*self.keys, self.at))
        self.store(known if new is None else known.filter(F.col(self.at) + self.delay_ms >= new), "seen", batch_id)


BLOCK_COLUMNS = ["symbol", "block_ts_ms", "book_event_id", *bl.TOP, "signed_volume_lenient"]
BLOCK_STATE = ["symbol", "block_ts_ms", "book_event_id", "mid", "mid_ret", "reconnect", "top_px_change", "book_change", "signed_volume_window"]


class BlockState(Stored):
    """Returns, change flags and rolling flow of each block, from the batch operators over a batch and what earlier ones left.

    What is left is each symbol's last block and its blocks inside the flow window (``carry``). Results are in ``rows``. A block
    that is not after its symbol's last one, or comes twice, goes to ``late``. A symbol without blocks for ``timeout_ms`` is forgotten.
    """

    def __init__(self, spark: SparkSession, path: str, reconnect_gap_ms: int, window_ms: int, timeout_ms: int | None = None) -> None:
        super().__init__(spark, path)
        self.reconnect_gap_ms, self.window_ms, self.timeout_ms = reconnect_gap_ms, window_ms, timeout_ms

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        batch = self.store(batch.select(*BLOCK_COLUMNS).filter(F.col("block_ts_ms").isNotNull()), "batch", batch_id)
        carry = self.before("carry", batch_id, batch)
        place = F.struct(*bl.BLOCK)
        last = carry.groupBy("symbol").agg(F.max(place).alias("_last"))
        placed = batch.join(last, "symbol", "left")
        late = F.coalesce(place <= F.col("_last"), F.lit(False))
        self.store(placed.filter(late).drop("_last"), "late", batch_id)
        series = placed.filter(~late).drop("_last").withColumn("_new", F.lit(True)).unionByName(carry.withColumn("_new", F.lit(False)))
        series = self.store(series, "series", batch_id)
        state = bl.rolling_sum(bl.market_state(series, reconnect_gap_ms=self.reconnect_gap_ms), "signed_volume_lenient", self.window_ms)
        self.store(state.filter("_new").select(*BLOCK_STATE), "rows", batch_id)
        newest = series.groupBy("symbol").agg(F.max("block_ts_ms").alias("_newest"))
        if self.timeout_ms is not None:
            latest = series.agg(F.max("block_ts_ms")).first()[0]
            newest = newest.filter(F.col("_newest") >= F.lit(latest) - self.timeout_ms)
        inside = series.join(newest, "symbol").filter(F.col("block_ts_ms") >= F.col("_newest") - self.window_ms)
        self.store(inside.select(*BLOCK_COLUMNS), "carry", batch_id)


def markout_input(fills: DataFrame, mids: DataFrame) -> DataFrame:
    """Fills (symbol, fill_id, side, px, ts_ms) and mids (symbol, event_id, mid, ts_ms) as one stream, so that one clock covers both."""
    one = fills.select("symbol", F.lit("fill").alias("kind"), "ts_ms", F.col("fill_id").alias("id"), "side", "px")
    two = mids.select("symbol", F.lit("mid").alias("kind"), "ts_ms", F.col("event_id").alias("id"), F.lit(None).cast("string").alias("side"), F.col("mid").alias("px"))
    return one.unionByName(two)


class FillMarkout(Stored):
    """Each fill with the first mid in ``[t + horizon, t + horizon + tolerance]``, once the watermark has passed that time.

    Takes :func:`markout_input`. Fills whose time has come meet the stored mids by an as-of search; one without a mid has a null markout.
    Results are in ``rows``, rows behind the watermark in ``late``. Kept are fills that wait, and mids that these or later fills may need.
    """

    def __init__(self, spark: SparkSession, path: str, horizon_ms: int, tolerance_ms: int, delay_ms: int) -> None:
        super().__init__(spark, path)
        self.horizon_ms, self.tolerance_ms, self.delay_ms = horizon_ms, tolerance_ms, delay_ms

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        batch = self.store(batch, "batch", batch_id)
        old, new = self.clock(batch, "ts_ms", self.delay_ms, batch_id)
        on_time = F.coalesce(_not_before("ts_ms", old), F.lit(False))
        fill, mid = F.col("kind") == "fill", (F.col("kind") == "mid") & F.col("px").isNotNull()
        self.store(batch.filter((fill | mid) & ~on_time), "late", batch_id)
        due = F.col("ts_ms") + self.horizon_ms
        waiting = self.before("waiting", batch_id, batch).unionByName(batch.filter(fill & on_time))
        mids = self.before("mids", batch_id, batch).unionByName(batch.filter(mid & on_time))
        ripe = F.lit(False) if new is None else due + self.tolerance_ms < new
        quotes = mids.select("symbol", F.col("ts_ms").alias("_at"), F.col("id").alias("_id"), F.col("px").alias("_mid"))
        asked = waiting.filter(ripe).withColumn("_due", due)
        met = asof(asked, quotes, ["symbol"], at="_due", quote_at="_at", payload=["_mid"], ties=["_id"], direction="forward", into="_hit")
        future = F.when(F.col("_hit.at_ms") <= F.col("_due") + self.tolerance_ms, F.col("_hit._mid"))
        gain = F.when(F.col("side") == "buy", future - F.col("px")).otherwise(F.col("px") - future)
        self.store(met.select("symbol", F.col("id").alias("fill_id"), "side", gain.alias("markout")), "rows", batch_id)
        left = self.store(waiting.filter(~ripe), "waiting", batch_id)
        needed = left.groupBy("symbol").agg(F.min(due).alias("_from"))
        later = F.lit(True) if new is None else F.col("ts_ms") >= new + self.horizon_ms
        kept = mids.join(needed, "symbol", "left").filter(later | F.coalesce(F.col("ts_ms") >= F.col("_from"), F.lit(False))).drop("_from")
        self.store(kept, "mids", batch_id)


class RunMonitor(Stored):
    """Newest status of each run and the roll-up over them, kept up to date as run reports arrive.

    A batch writes a new version of both from the version before and its own reports, then publishes its number. Readers take the
    published version, which no later batch touches; a batch that was published already is not done again.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 10) -> None:
        super().__init__(spark, path)
        self.window = window

    def published(self) -> int | None:
        try:
            return self.spark.read.parquet(f"{self.path}/published").agg(F.max("version")).first()[0]
        except AnalysisException:
            return None

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        done = self.published()
        if done is not None and batch_id <= done:
            return
        own = gates.run_status(batch)
        rows = own.withColumn("_new", F.lit(1)).unionByName(self.before("newest", batch_id, own).withColumn("_new", F.lit(0)))
        rest = [c for c in own.columns if c != "run_id"]
        newest = rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct("mtime", "_new")).alias("_row"))
        newest = self.store(newest.select("run_id", "_row.*").select(*own.columns), "newest", batch_id)
        self.store(gates.monitor_rollup(newest, self.window), "rollup", batch_id)
        self.spark.range(1).select(F.lit(batch_id).cast("bigint").alias("version")).write.mode("append").parquet(f"{self.path}/published")

    def statuses(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/newest/batch={self.published()}")

    def rollup(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rollup/batch={self.published()}")
