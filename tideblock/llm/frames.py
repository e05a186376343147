"""Spark plumbing shared by the operators: Arrow tasks over whole texts, samples of bounded size, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideblock.llm.words import slices
from tideblock.scratch import keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Only the named columns, so that other columns of the same names as results can't clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many signs as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_slice(work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls ``work`` on slices of bounded text size (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(batch.schema.get_field_index("text"))):
                out = work(batch.slice(low, high - low))
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return run


class Cache:
    """Values by key for a task's process, in bounded memory: of a full half, only keys asked for again stay.

    A half holds at most ``limit`` bytes of keys and values, with ``ENTRY`` bytes counted for each pair's own upkeep. Keys of more than
    ``LONGEST_KEY`` characters, such as whole paragraphs of scripts without spaces, seldom return and are never held.
    """

    ENTRY = 200
    LONGEST_KEY = 64

    def __init__(self, limit: int = 100 << 20):
        self.limit, self.young, self.old = limit, {}, {}
        self.young_bytes = self.old_bytes = 0

    def _size(self, key: str, value) -> int:
        return self.ENTRY + 4 * len(key) + (len(value) if isinstance(value, bytes) else 8)

    def get(self, keys: list, compute: Callable[[list], Iterable]) -> list:
        """Values of distinct keys; ``compute`` gets those that are not held."""
        out = [self.old.get(k) for k in keys]
        fresh = []
        for i in [i for i, v in enumerate(out) if v is None]:
            v = self.young.pop(keys[i], None)
            if v is None:
                fresh.append(i)
            else:
                out[i] = v
                size = self._size(keys[i], v)
                self.young_bytes -= size
                if self.old_bytes + size > self.limit:
                    self.old, self.old_bytes = {}, 0
                self.old[keys[i]] = v
                self.old_bytes += size
        for i, v in zip(fresh, compute([keys[i] for i in fresh]) if fresh else (), strict=True):
            out[i] = v
            if len(keys[i]) <= self.LONGEST_KEY:
                size = self._size(keys[i], v)
                if self.young_bytes + size > self.limit:
                    self.young, self.young_bytes = {}, 0
                self.young[keys[i]] = v
                self.young_bytes += size
        return out


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def stratified(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (all, if it has fewer), chosen by a hash of ``key``.

    Labels must be few. The same rows are chosen at every run; counts are aggregated before the shuffle.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_label")
    share = F.lit(per_label) / F.col("_n")
    place = (F.xxhash64(F.col(key), F.lit("sample")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    return df.join(F.broadcast(counts), F.col(label) == F.col("_label")).where(place < share).drop("_n", "_label")


def learned(sample: DataFrame, learn: Callable[[list[pa.RecordBatch]], bytes]) -> bytes:
    """Train on a sample of bounded size in one task of an executor; only the model, of fixed size, reaches the driver.

    The sample (doc_id and more) comes in order of doc_id, so the model does not hang on the order of its arrival.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        held = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks().to_batches() if held else []
        yield pa.RecordBatch.from_pydict({"model": pa.array([learn(held)], pa.binary())})

    row = sample.repartition(1).mapInArrow(run, "model binary").first()  # all tasks scan; only the sample meets in one
    return bytes(row[0]) if row else learn([])


def summed(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int, parts: int = 16) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers, which ``add`` adds a batch to.

    Each task gives one vector; ``added`` adds those up.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            add(total, batch)
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

    return added(df.mapInArrow(scan, "sum binary"), size, parts)


def added(made: DataFrame, size: int, parts: int = 16) -> np.ndarray:
    """Sum of the vectors of ``size`` numbers in the column ``sum`` (bytes), one vector or so from each task.

    Fewer and fewer tasks add them up, and the driver gets ``parts`` vectors at any size of the input.
    """

    def plus(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for x in batch.column(0):
            total += np.frombuffer(x.as_buffer(), np.float64)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            plus(total, batch)
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

    n = made.rdd.getNumPartitions()
    while n > 16 * parts:  # no task adds up more than a few dozen vectors
        n = -(-n // 16)
        made = made.repartition(n).mapInArrow(fold, "sum binary")
    rows = made.repartition(parts).mapInArrow(fold, "sum binary").collect()
    return np.sum([np.frombuffer(r[0], np.float64) for r in rows], axis=0) if rows else np.zeros(size)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node reachable.

    Alternating large-star and small-star steps; each result is written to the shared folder, and so are the smallest neighbours, so that
    a join with a node of very many edges can be split. Nodes must not be null.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    now = keep(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = keep(small.select("e.*").where("u != v").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
