"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances as in an exact search by distance: with one more component sqrt(M - |x|**2) for each vector (M: the largest
squared length) and 0 for a query, the nearest vectors are those of the largest inner product.

Equal vectors are one entry with its smallest ids, so copies neither crowd a leaf nor multiply pairs. The upper tree is fitted to a sample
of bounded size; its leaves are regions. All entries of a region, in parts of bounded size, get a lower tree of their own, down to leaves
of about ``LEAF`` entries; a part with its tree is one row of a written table. A query descends the upper tree with a priority queue
(nearest centre first) to ``regions`` regions, and in each of their parts the lower tree likewise to ``visits`` leaves.

How many regions and leaves that takes is calibrated: for a sample of queries the exact answers are found by brute force, and the places of
their leaves in the queues' order give the recall of every choice. The cheapest choice that reaches ``TARGET`` is taken.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideblock.llm.frames import learned
from tideblock.scratch import keep

FANOUT = 16
LEAF = 64
PART = 8192
REGIONS = 16_384
SAMPLE_BYTES = 64 << 20
CALIBRATION = 256
TARGET = 0.95
QUERIES = 512
ROUNDS = 8
ROUNDING = 1e-9
FOUND = "query_id long, score double, ids array<long>, copies array<int>"


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Nodes with centres; node 0 is the root. A leaf's ``child`` is -1 - its number, another node's children follow each other."""

    centre: np.ndarray
    child: np.ndarray
    children: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())

    def order(self, distance: np.ndarray, most: int) -> list[int]:
        """Best bin first: the first ``most`` leaves out of a priority queue of nodes, for one row of distances to all centres."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node] == 0:
                out.append(-1 - int(self.child[node]))
            else:
                for c in range(self.child[node], self.child[node] + self.children[node]):
                    heapq.heappush(queue, (float(distance[c]), c))
        return out

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, down the nearest centres."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.children[node] > 0
            if not inner.any():
                return -1 - self.child[node]
            for n in np.unique(node[inner]):
                some = np.flatnonzero(node == n)
                a = self.child[n]
                node[some] = a + squares(x[some], self.centre[a : a + self.children[n]]).argmin(axis=1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def means(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means with centres from the data: (centres, nearest centre of each row). Empty groups are left out."""
    r = np.random.default_rng(seed)
    centre = x[r.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = squares(x, centre).argmin(axis=1)
        held, near = np.unique(near, return_inverse=True)
        by = np.argsort(near, kind="stable")
        first = np.searchsorted(near[by], np.arange(len(held)))
        centre = np.add.reduceat(x[by], first) / np.bincount(near)[:, None]
    near = squares(x, centre).argmin(axis=1)
    held, near = np.unique(near, return_inverse=True)
    return centre[held], near


def grow(x: np.ndarray, leaf: int) -> tuple[Tree, np.ndarray]:
    """A tree whose leaves hold at most ``leaf`` rows each (more, if they are alike), and the leaf of each row."""
    centre, child, children = [x.mean(axis=0)], [0], [0]
    place, leaves, todo = np.zeros(len(x), np.int64), 0, [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        k = min(FANOUT, -(-len(rows) * 2 // leaf))
        groups, near = means(x[rows], k, node) if len(rows) > leaf else (None, None)
        if groups is None or len(groups) == 1:
            child[node], leaves = -1 - leaves, leaves + 1
            place[rows] = -1 - child[node]
            continue
        child[node], children[node] = len(centre), len(groups)
        for g, c in enumerate(groups):
            todo.append((len(centre), rows[near == g]))
            centre.append(c)
            child.append(0)
            children.append(0)
    return Tree(np.stack(centre), np.array(child), np.array(children)), place


# ---------------------------------------------------------------- the index


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, vec (doubles), square: rows with an id and finite components that are not all zero."""
    finite = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = table.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite)
    rows = rows.where(F.exists(embedding, lambda x: x != 0))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    return rows.withColumn("square", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """One row for each different vector: vec, ids (its k + 1 smallest, as no answer has others) and copies (rows of each id)."""
    counted = rows.groupBy("vec", "vec_id").agg(F.count("*").alias("n"))
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = counted.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    own = F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(k)).cast("int").alias("copies"))))
    held = few.groupBy("vec").agg(own.alias("own"))
    return held.select("vec", F.col("own.vec_id").alias("ids"), F.col("own.copies").alias("copies"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]])


def fit(rows: DataFrame, count: int, dims: int, most: float) -> Tree:
    """The upper tree, from a sample of at most about ``SAMPLE_BYTES``: leaves of ``PART`` entries or so, ``REGIONS`` at most."""
    size = max(FANOUT, min(count, SAMPLE_BYTES // (8 * dims)))
    wanted = max(1, min(REGIONS, -(-count // PART), (SAMPLE_BYTES // 4) // (8 * dims)))
    place = F.pmod(F.xxhash64("vec", F.lit("sample")), F.lit(1_000_003)) / 1_000_003.0
    sample = rows.where(place < size / count).select(F.element_at("ids", 1).alias("doc_id"), "vec")

    def learn(batches: list[pa.RecordBatch]) -> bytes:
        x = np.vstack([_matrix(b.column(1), dims) for b in batches]) if batches else np.zeros((1, dims))
        return pickle.dumps(grow(_lifted(x, most), max(1, -(-len(x) // wanted)) if wanted > 1 else len(x))[0])

    return pickle.loads(learned(sample, learn))


PARTS = "region long, part long, tree binary, vectors binary, edges binary, ids array<array<long>>, copies array<array<int>>"


def index(rows: DataFrame, upper: Tree, dims: int, most: float) -> DataFrame:
    """All entries, in parts of their regions, each with its lower tree and its entries in order of the leaves."""
    held = rows.sparkSession.sparkContext.broadcast(upper)
    leaf = LEAF

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = held.value.place(_lifted(_matrix(batch.column(0), dims), most)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), *batch.columns], names=["region", "vec", "ids", "copies"])

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _matrix(group["vec"].chunk(0), dims)
        tree, place = grow(_lifted(x, most), leaf)
        by = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[by], np.arange(tree.leaves + 1))
        order = pa.array(by)
        values = [[group[c][0].as_py()] for c in ("region", "part")] + [[pickle.dumps(tree)], [x[by].tobytes()], [edges.astype(np.int64).tobytes()]]
        lists = [pa.array([group[c].take(order).to_pylist()], pa.list_(pa.list_(kind))) for c, kind in (("ids", pa.int64()), ("copies", pa.int32()))]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(values, kinds, strict=True)] + lists, names=["region", "part", "tree", "vectors", "edges", "ids", "copies"])

    routed = keep(rows.select("vec", "ids", "copies").mapInArrow(route, "region long, vec array<double>, ids array<long>, copies array<int>"), "routed")
    size = routed.groupBy("region").agg(F.ceil(F.count("*") / PART).alias("parts"))
    parted = routed.join(size, "region").withColumn("part", F.pmod(F.xxhash64("vec"), "parts")).drop("parts")
    return keep(parted.groupBy("region", "part").applyInArrow(build, PARTS), "parts")


# ---------------------------------------------------------------- the search


def routed_queries(asked: DataFrame, upper: Tree, regions: int, dims: int) -> DataFrame:
    """Blocks of queries by region: region, seen (the region's place in each query's queue), ids, vectors."""
    held = asked.sparkSession.sparkContext.broadcast(upper)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dims)
            lifted = np.hstack([x, np.zeros((len(x), 1))])
            for low in range(0, len(x), 256):
                far = squares(lifted[low : low + 256], tree.centre)
                seen = [tree.order(d, regions) for d in far]
                row = np.repeat(np.arange(low, low + len(far)), [len(s) for s in seen])
                flat = [np.concatenate(seen), np.concatenate([np.arange(len(s)) for s in seen])]
                yield pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1].astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["region", "seen", "query_id", "vec"])

    pairs = keep(asked.select("vec_id", "vec").mapInArrow(route, "region long, seen int, query_id long, vec array<double>"), "asked")
    size = pairs.groupBy("region").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
    parted = pairs.join(size, "region").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
    together = F.collect_list(F.struct("query_id", "seen", "vec"))  # about QUERIES rows
    return parted.groupBy("region", "block").agg(together.alias("q")).select("region", F.col("q.query_id").alias("asked"), F.col("q.seen").alias("seen"), F.flatten("q.vec").alias("asked_vectors"))


class Part:
    """A read part, and queries that reach it."""

    def __init__(self, batch: pa.RecordBatch, i: int, dims: int):
        get = lambda c: batch.column(batch.schema.get_field_index(c))[i]
        self.tree: Tree = pickle.loads(get("tree").as_py())
        self.vec = np.frombuffer(get("vectors").as_buffer(), np.float64).reshape(-1, dims)
        self.edges = np.frombuffer(get("edges").as_buffer(), np.int64)
        self.ids, self.copies = get("ids").values, get("copies").values
        self.asked, self.seen = get("asked").values.to_numpy(), get("seen").values.to_numpy()
        self.queries = get("asked_vectors").values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        self.far = squares(np.hstack([self.queries, np.zeros((len(self.queries), 1))]), self.tree.centre)

    def best(self, visits: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, entries, scores): the best entries of each query in the leaves that come first out of its queue."""
        leaves: list[list[int]] = [[] for _ in range(self.tree.leaves)]
        for q, far in enumerate(self.far):
            for leaf in self.tree.order(far, visits):
                leaves[leaf].append(q)
        scores: list[list[np.ndarray]] = [[] for _ in self.asked]
        places: list[list[np.ndarray]] = [[] for _ in self.asked]
        for leaf, some in enumerate(leaves):
            if some:
                a, b = self.edges[leaf : leaf + 2]
                for q, s in zip(some, self.queries[some] @ self.vec[a:b].T, strict=True):
                    scores[q].append(s)
                    places[q].append(np.arange(a, b))
        for q in range(len(self.asked)):
            if not scores[q]:
                continue
            score, place = np.concatenate(scores[q]), np.concatenate(places[q])
            if len(score) > k:
                least = np.partition(score, -k)[-k]
                near = score >= least - ROUNDING * max(1.0, abs(least))
                place = place[near]
            # Products of matrices round by their shape: equal vectors get equal scores only this way.
            exact = (self.vec[place] * self.queries[q]).sum(axis=1)
            yield q, place, exact


def _answer(k: int, visits: int, dims: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, dims)
                query, place, score = [], [], []
                for q, own, exact in part.best(visits, k + 1):
                    least = part.ids.flatten().to_numpy()[part.ids.offsets.to_numpy()[own] - part.ids.offsets[0].as_py()]
                    top = np.lexsort((least, -exact))[: k + 1]
                    query.append(np.full(len(top), part.asked[q]))
                    place.append(own[top])
                    score.append(exact[top])
                if query:
                    at = pa.array(np.concatenate(place))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), pa.array(np.concatenate(score)), part.ids.take(at), part.copies.take(at)], names=["query_id", "score", "ids", "copies"])

    return work


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: ids of the best entries, without the query's own, ties to the smaller."""
    least = Window.partitionBy("query_id").orderBy(F.desc("score"), F.element_at("ids", 1))
    few = found.withColumn("place", F.row_number().over(least)).where(F.col("place") <= k + 1)
    pairs = few.select("query_id", "score", F.explode(F.arrays_zip("ids", "copies")).alias("c")).where("c.ids != query_id")
    rows = pairs.select("query_id", "score", F.col("c.ids").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("c.copies"))).alias("copy"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(rows: DataFrame, asked: list, k: int, dims: int) -> DataFrame:
    """The true answers of a few queries by brute force over all entries."""
    held = rows.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in asked], np.int64), np.array([r.vec for r in asked])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), dims)
            score = queries @ x.T
            few = min(k + 1, len(x))
            place = np.argpartition(-score, few - 1, axis=1)[:, :few]
            at = pa.array(place.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, few)), pa.array(np.take_along_axis(score, place, 1).ravel()), batch.column(1).take(at), batch.column(2).take(at)], names=["query_id", "score", "ids", "copies"])

    return merged(rows.select("vec", "ids", "copies").mapInArrow(scan, FOUND), k)


def places(blocks: DataFrame, truth: dict[int, set[int]], dims: int) -> DataFrame:
    """(query_id, region, leaf): how late the region and the leaf of each true answer come out of the queues."""
    held = blocks.sparkSession.sparkContext.broadcast(truth)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch, i, dims)
                owner = np.repeat(np.arange(len(part.ids)), np.diff(part.ids.offsets.to_numpy()))
                flat, out = part.ids.flatten().to_numpy(), []
                for q, query in enumerate(part.asked.tolist()):
                    hit = np.flatnonzero(np.isin(flat, list(held.value.get(query, ()))))
                    if len(hit):
                        rank = {leaf: n for n, leaf in enumerate(part.tree.order(part.far[q], part.tree.leaves))}
                        leaf = np.searchsorted(part.edges, owner[hit], side="right") - 1
                        out += [(query, int(part.seen[q]), rank[n]) for n in leaf.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["query_id", "region", "leaf"])

    return blocks.mapInArrow(work, "query_id long, region int, leaf int")


def cheapest(late: list[tuple[int, int]], wanted: int) -> tuple[int, int]:
    """(regions, visits) of the least product that catch ``wanted`` of the answers with these places in the queues."""
    region, leaf = (np.array(x) for x in zip(*late, strict=True))
    best = (math.inf, 0, 0)
    for r in np.unique(region).tolist():
        inside = np.sort(leaf[region <= r])
        if len(inside) >= wanted:
            v = int(inside[wanted - 1]) + 1
            best = min(best, ((r + 1) * v, r + 1, v))
    return best[1:]


def calibrated(rows: DataFrame, asked: DataFrame, parts: DataFrame, upper: Tree, k: int, dims: int) -> tuple[int, int]:
    """Regions and leaves for a recall of ``TARGET`` on a sample of queries (all answers, where copies leave none to count)."""
    count = asked.count()
    place = F.pmod(F.xxhash64("vec_id", F.lit("calibration")), F.lit(1_000_003)) / 1_000_003.0
    few = asked.where(place < min(1.0, CALIBRATION / max(count, 1))).limit(2 * CALIBRATION).collect() or asked.limit(1).collect()
    if not few:
        return 1, 1
    truth: dict[int, set[int]] = {}
    for r in exact(rows, few, k, dims).collect():  # at most 2 * CALIBRATION * k rows
        truth.setdefault(r.query_id, set()).add(r.vec_id)
    some = rows.sparkSession.createDataFrame([(r.vec_id, r.vec) for r in few], "vec_id long, vec array<double>")
    blocks = routed_queries(some, upper, upper.leaves, dims).join(parts, "region")
    late = [(r.region, r.leaf) for r in places(blocks, truth, dims).collect()]
    return cheapest(late, math.ceil(TARGET * len(late))) if late else (1, 1)


def nearest(table: DataFrame, is_query, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: about the ``k`` rows of the largest inner product for each query (all, if fewer).

    Queries are the rows where ``is_query`` (a condition on vec_id) holds, candidates all rows but those with the query's id; ties go to
    the smaller vec_id. Null ids and vectors that are null, zero, or hold a null or non-finite component take no part; vectors of different
    lengths are not compared. Repeated rows are candidates each; a repeated query id is one query, with its smallest vector. Squared
    lengths must be finite. An empty table gives no row. Other columns are not read.
    """
    spark = table.sparkSession
    rows = keep(vectors(table, vec_id, embedding), "vectors")
    out = spark.createDataFrame([], FOUND)
    for dims, most in rows.groupBy(F.size("vec").alias("dims")).agg(F.max("square").alias("m")).sort("dims").collect():
        if not math.isfinite(most):
            raise ValueError("a vector's squared length is not finite")
        same = rows.where(F.size("vec") == dims)
        held = keep(entries(same, k), "entries")
        upper = fit(held, held.count(), dims, most)
        parts = index(held, upper, dims, most)
        asked = keep(same.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
        regions, visits = calibrated(held, asked, parts, upper, k, dims)
        blocks = routed_queries(asked, upper, regions, dims).join(parts, "region")
        out = out.unionByName(blocks.mapInArrow(_answer(k, visits, dims), FOUND))
    return merged(out, k)
