"""Exact top-k by inner product: an M-tree of paged nodes, searched best first.

Inner products become distances: with one more component sqrt(M - |x|**2) for each vector (M: the largest squared length) and 0 for a
query, |q - x|**2 = |q|**2 + M - 2 * q.x, so the nearest are the best and the triangle inequality holds.

The root has at most ``ROOTS`` routing objects, picked far apart from a sample of bounded size. Every vector goes to its nearest one; a
page is some vectors of one routing object in order of their distance to it. A page stores its own routing object, covering radius,
distance to the parent, and its members' distances to its routing object. A query visits pages in order of their lower bounds, which
first come from stored distances alone, and stops at its k-th best so far; in a page only members that the stored distances
don't rule out are computed. Scores are exact integers; bounds give way by a small margin, so rounding loses nothing.

Queries go out in blocks of bounded size, each against all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideblock.scratch import keep

ROOTS = 64
SAMPLE = 4096
PAGE = 128
REGION_ROWS = 16_384
QUERIES = 2048
MARGIN = 1e-6
PAGES = "root int, radius double, above double, ids binary, vectors binary, distances binary"


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec (floor(256 * x)), square: rows with an id and finite components only."""
    finite = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = table.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite)
    vec = F.transform(embedding, lambda x: F.floor(256 * x.cast("double")).cast("long"))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"))
    return rows.withColumn("square", F.aggregate("vec", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


def routing(sample: np.ndarray, most: float) -> np.ndarray:
    """At most ``ROOTS`` vectors of the sample, each far from those before."""
    lifted = _lifted(sample, most)
    chosen = [0]
    near = _distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < min(ROOTS, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(lifted, lifted[chosen[-1:]])[:, 0])
    return lifted[chosen]


def pages(rows: DataFrame, roots: np.ndarray, most: float, dims: int) -> DataFrame:
    """The tree's leaf pages. A routing object of many vectors is split by a hash, so that no task gets them all."""
    held = rows.sparkSession.sparkContext.broadcast(roots)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_lifted(_matrix(batch.column(1), dims), most), held.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), batch.column(0), batch.column(1)], names=["root", "far", "vec_id", "vec"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            done = rest.num_rows // PAGE * PAGE
            yield from whole(rest.slice(0, done))
            rest = rest.slice(done)
        if rest is not None:
            yield from whole(rest)

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        root = batch.column(0).to_numpy()
        breaks = np.flatnonzero(np.diff(root)) + 1
        edges = np.unique(np.concatenate([breaks, np.arange(0, batch.num_rows, PAGE), [batch.num_rows]])).astype(int)
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            vec = _matrix(part.column(3), dims)
            lifted = _lifted(vec, most)
            middle = int(((lifted - lifted.mean(axis=0)) ** 2).sum(axis=1).argmin())
            order = np.argsort(np.arange(b - a) != middle, kind="stable")  # the routing object is the page's first member
            d = _distances(lifted[order], lifted[middle : middle + 1])[:, 0]
            d[0] = 0
            rows.append((int(root[a]), float(d.max()), float(part.column(1)[middle].as_py()), part.column(2).to_numpy()[order].tobytes(), vec[order].tobytes(), d.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["root", "radius", "above", "ids", "vectors", "distances"])

    near = keep(rows.select("vec_id", "vec").mapInArrow(route, "root int, far double, vec_id long, vec array<long>"), "routed")
    size = near.groupBy("root").agg(F.ceil(F.count("*") / REGION_ROWS).alias("regions"))  # at most ROOTS rows
    placed = near.join(F.broadcast(size), "root").withColumn("region", F.pmod(F.xxhash64("vec_id"), "regions"))
    return keep(placed.repartition("root", "region").sortWithinPartitions("root", "region", "far").select("root", "far", "vec_id", "vec").mapInArrow(cut, PAGES), "pages")


class Block:
    """Some queries, with their distances to the routing objects and the k-th best score that a sample already gives."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, roots: np.ndarray, most: float, k: int, sample_ids: np.ndarray, sample: np.ndarray):
        self.ids, self.vec, self.most, self.k = ids, vec, most, k
        self.lifted = np.hstack([vec.astype(np.float64), np.zeros((len(vec), 1))])
        self.square = (self.lifted**2).sum(axis=1)
        self.to_root = _distances(self.lifted, roots)
        score = vec @ sample.T
        score[ids[:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
        top = np.sort(score, axis=1)[:, -k:] if score.shape[1] >= k else None
        self.floor = top[:, 0] if top is not None else np.full(len(ids), np.iinfo(np.int64).min)

    def reach(self, q: int, score: int) -> float:
        """The largest distance at which a vector can have that score."""
        if score == np.iinfo(np.int64).min:
            return np.inf
        return float(np.sqrt(max(0.0, self.square[q] + self.most - 2.0 * score))) * (1 + MARGIN) + MARGIN


class Answers:
    """The best k of one task for each query."""

    def __init__(self, block: Block):
        self.block = block
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        self.cut = [block.reach(q, int(s)) for q, s in enumerate(block.floor)]

    def visit(self, batch: pa.RecordBatch) -> None:
        b = self.block
        root, radius, above = (batch.column(i).to_numpy() for i in range(3))
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
        vec = [np.frombuffer(x.as_buffer(), np.int64).reshape(len(i), -1) for x, i in zip(batch.column(4), ids, strict=True)]
        inner = [np.frombuffer(x.as_buffer(), np.float64) for x in batch.column(5)]
        centers = _lifted(np.stack([v[0] for v in vec]), b.most)
        for q in range(len(b.ids)):
            bound = np.abs(b.to_root[q, root] - above) - radius
            open_pages = np.flatnonzero(bound <= self.cut[q])
            if not len(open_pages):
                continue
            d = _distances(b.lifted[q : q + 1], centers[open_pages])[0]
            bound = d - radius[open_pages]
            for p in np.argsort(bound, kind="stable"):
                if bound[p] > self.cut[q]:
                    break
                page = open_pages[p]
                some = np.flatnonzero(np.abs(inner[page] - d[p]) <= self.cut[q])
                if len(some):
                    self._offer(q, ids[page][some], vec[page][some] @ b.vec[q])

    def _offer(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != self.block.ids[q]
        ids, score = ids[other], score[other]
        best = self.best[q]
        floor = max(int(self.block.floor[q]), -best[-1][0]) if len(best) == self.block.k else int(self.block.floor[q])
        good = score >= floor
        if good.any():
            best = sorted(best + [(-s, i) for s, i in zip(score[good].tolist(), ids[good].tolist(), strict=True)])[: self.block.k]
            self.best[q] = best
            if len(best) == self.block.k:
                self.cut[q] = min(self.cut[q], self.block.reach(q, -best[-1][0]))

    def rows(self) -> pa.RecordBatch:
        found = [(int(i), v, -s) for i, best in zip(self.block.ids, self.best, strict=True) for s, v in best]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else ([],) * 3)], names=["query_id", "vec_id", "score"])


def top_k(table: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of the highest integer inner product for each query (all, if fewer).

    Queries are the rows where ``is_query`` (a condition on vec_id) holds, candidates all rows but those with the query's id; ties go to
    the smaller vec_id. Null ids, null vectors and vectors with a null or non-finite component take no part, and vectors of different
    lengths are not compared. Repeated rows are candidates each; a repeated query id is one query, with its smallest vector.
    """
    spark = table.sparkSession
    rows = keep(vectors(table, vec_id, embedding), "vectors")
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for dims, most, count in rows.groupBy(F.size("vec").alias("dims")).agg(F.max("square").alias("m"), F.count("*").alias("n")).sort("dims").collect():
        same = rows.where(F.size("vec") == dims)
        if dims == 0:
            continue
        part = min(1.0, SAMPLE / count)
        place = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
        taken = same.where(place < part).limit(2 * SAMPLE).collect() or same.limit(1).collect()
        sample_ids, sample = np.array([r.vec_id for r in taken], np.int64), np.array([r.vec for r in taken], np.int64)
        _, single = np.unique(sample_ids, return_index=True)
        roots = routing(sample, most)
        tree = pages(same, roots, most, dims)
        asked = same.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
        blocks = max(1, -(-asked.count() // QUERIES))
        for i in range(blocks):
            chosen = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).collect()
            if not chosen:
                continue
            block = Block(np.array([r.vec_id for r in chosen], np.int64), np.array([r.vec for r in chosen], np.int64), roots, most, k, sample_ids[single], sample[single])
            held = spark.sparkContext.broadcast(block)

            def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                answers = Answers(held.value)
                for batch in batches:
                    if batch.num_rows:
                        answers.visit(batch)
                yield answers.rows()

            out = out.unionByName(tree.mapInArrow(search, "query_id long, vec_id long, score long"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
with v as (
  select vec_id, [floor(256 * cast(x as double)) for x in embedding] as vec from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len(embedding) > 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.vec, c.vec) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.vec) = len(c.vec)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
