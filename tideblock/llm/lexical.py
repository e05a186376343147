"""Ranked lexical search: the best documents for each item by exact integer weights, term at a time, then document at a time.

Documents become segments of bounded size, each with the postings of the items' terms only; a segment is one row of a written table, so
all global counts (documents, lengths, document frequencies) are sums over that table. Each segment then answers every item:

* Term at a time: the shortest lists are added up into accumulators, as long as their postings together stay few. The accumulators, in
  document order, count as one list from then on.
* Document at a time: windows of documents are passed in order with the accumulators and the long lists as iterators, each with its
  highest score in every window. A window is skipped when these bounds together can't reach the k-th best score so far. Inside a window
  documents come only from the lists that could lift one that high (the others alone can't), and the rest are looked up from the list
  of the highest bound down, for documents that can still get there.

All weights are positive, so the k-th best accumulator is a valid bound to begin with. A bound must be missed, not met, to skip, so ties stay.
Terms are told apart by 64-bit hashes. Items go in blocks of bounded size, each block with segments of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, texts
from tideblock.llm.words import Words, raw_texts, words
from tideblock.scratch import keep

BLOCK_TERMS = 1_000_000
SEGMENT_DOCS = 32_768
SEGMENT_POSTINGS = 1_000_000
WINDOW = 1024
SHORT_SHARE = 8  # the lists taken term at a time hold at most this part of a segment's documents
# Fixed values of the ranking formula.
SCALE, FLAT, STEEP, NUMERATOR, SATURATION = 1000, 25, 75, 1_000_000_000, 8

_TERM = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM[_low : _high + 1] = np.arange(_low, _high + 1)

ITEMS = "item_id long, terms array<long>"
SEGMENTS = "ids array<long>, lengths array<int>, texts long, total long, term binary, size binary, doc binary, count binary"
FOUND = "item_id long, doc_id long, score long"


def terms(column: pa.Array) -> Words:
    """Terms of every text: runs of letters, digits and bytes from 0x80, A-Z lower-cased."""
    raw, offsets = raw_texts(column)
    plain = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_TERM[raw].tobytes())])
    return words(plain)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, terms): hashed terms with repeats of each item; rows of one id are one item. Items without a term are left out."""

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = terms(batch.column(1))
        held = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(w.hashes().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), held], names=["item_id", "terms"])

    rows = texts(items, item_id, text).withColumnRenamed("doc_id", "item_id").mapInArrow(by_slice(split), ITEMS)
    return rows.groupBy("item_id").agg(F.flatten(F.collect_list("terms")).alias("terms")).where(F.size("terms") > 0)


class Segment:
    """Postings being gathered for a segment."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, batch: pa.RecordBatch, vocabulary: np.ndarray) -> None:
        w = terms(batch.column(1))
        h = w.hashes().view(np.int64)
        place = np.searchsorted(vocabulary, h)
        place[place == len(vocabulary)] = 0
        hit = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
        doc = w.doc_of()[hit]
        key, count = np.unique(place[hit] * batch.num_rows + doc, return_counts=True)
        self.postings.append((key // batch.num_rows, self.docs + key % batch.num_rows, count))
        self.ids.append(batch.column(0))
        self.lengths.append(w.counts())
        self.docs += batch.num_rows
        self.size += len(key)

    def row(self) -> pa.RecordBatch:
        """The segment with its documents in order of their ids, nulls last, and postings in order of term and document."""
        ids = pa.concat_arrays(self.ids)
        order = pa.compute.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.concatenate(self.lengths)[order]
        term, doc, count = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        doc = place[doc]
        by = np.argsort(term * self.docs + doc)
        term, doc, count = term[by], doc[by], count[by]
        own, size = np.unique(term, return_counts=True)
        arrays = [
            pa.array([ids.take(pa.array(order))], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
            pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()),
            *[pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (own, size, doc, count)],
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "lengths", "texts", "total", "term", "size", "doc", "count"])


def segments(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    most, full = SEGMENT_DOCS, SEGMENT_POSTINGS

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Segment()

        def add(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            nonlocal now
            now.add(batch, held.value)
            if now.docs >= most or now.size >= full:
                done, now = now, Segment()
                yield done.row()

        yield from by_slice(add)(batches)
        if now.docs:
            yield now.row()

    return keep(docs.mapInArrow(index, SEGMENTS), "segments")


@dataclass
class Items:
    """Items of a block: of each, the places of its terms in the vocabulary and their weights times their repeats."""

    ids: list
    places: list[np.ndarray]
    weights: list[np.ndarray]
    texts: int
    total: int


def weigh(held: list, vocabulary: np.ndarray, counts: dict[int, int], n: int, total: int) -> Items:
    weight = np.array([math.floor(SCALE * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    weight[[t for t in range(len(vocabulary)) if t not in counts]] = 0  # in no document
    out = Items([], [], [], n, total)
    for item_id, own in held:
        hashes, times = np.unique(np.array(own, np.int64), return_counts=True)
        place = np.searchsorted(vocabulary, hashes)
        some = weight[place] > 0
        out.ids.append(item_id)
        out.places.append(place[some])
        out.weights.append(weight[place[some]] * times[some])
    return out


class Postings:
    """A read segment: impacts of all postings, and for each list its highest impact in every window."""

    def __init__(self, row: dict, texts_: int, total: int, window: int):
        lengths = np.asarray(row["lengths"], np.int64)
        self.docs, self.window = len(lengths), window
        norm = FLAT + STEEP * lengths * texts_ // max(total, 1)
        term, size, self.doc, count = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("term", "size", "doc", "count"))
        self.impact = NUMERATOR * count // (SCALE * count + SATURATION * norm[self.doc])
        edge = np.concatenate([[0], size.cumsum()])
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(term, edge[:-1], edge[1:], strict=True)}
        self.windows = -(-self.docs // window)
        self.looked = 0  # postings read document at a time

    def peaks(self, doc: np.ndarray, score: np.ndarray) -> np.ndarray:
        out = np.zeros(self.windows, np.int64)
        if len(doc):
            at = doc // self.window
            first = np.flatnonzero(np.diff(at, prepend=-1))
            out[at[first]] = np.maximum.reduceat(score, first)
        return out

    def best(self, places: np.ndarray, weights: np.ndarray, k: int, short_share: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the segment) and scores of the k best, best first, equal ones by place."""
        lists = sorted((b - a, a, b, int(w)) for a, b, w in ((*self.lists[int(t)], w) for t, w in zip(places, weights, strict=True) if int(t) in self.lists))
        # Term at a time: short lists into one.
        sums, few, room = np.zeros(self.docs, np.int64), 0, max(self.docs // short_share, self.window)
        while few < len(lists) and lists[few][0] <= room:
            n, a, b, w = lists[few]
            sums[self.doc[a:b]] += w * self.impact[a:b]
            room -= n
            few += 1
        doc = np.flatnonzero(sums)
        iterators = [(doc, sums[doc])] + [(self.doc[a:b], w * self.impact[a:b]) for _, a, b, w in lists[few:]]
        start = np.sort(iterators[0][1])[-k:]
        floor = int(start[0]) if len(start) == k else 1
        # Document at a time over the summed list and the long ones, by windows.
        peak = np.stack([self.peaks(d, s) for d, s in iterators])
        best_doc, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound = peak.sum(axis=0)
        for at in np.flatnonzero(bound >= floor).tolist():
            if bound[at] < floor:  # the floor has risen
                continue
            own, score = self._window(iterators, peak[:, at], at, floor)
            if len(own):
                best_doc, best_score = np.concatenate([best_doc, own]), np.concatenate([best_score, score])
                top = np.lexsort((best_doc, -best_score))[:k]
                best_doc, best_score = best_doc[top], best_score[top]
                if len(top) == k:
                    floor = max(floor, int(best_score[-1]))
        return best_doc, best_score

    def _window(self, iterators: list, peak: np.ndarray, at: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of one window with at least ``floor``, and their scores."""
        low, high = at * self.window, min(self.docs, (at + 1) * self.window)
        order = np.argsort(-peak, kind="stable")
        order = order[peak[order] > 0]
        left = np.concatenate([peak[order][::-1].cumsum()[::-1], [0]])  # what the lists from here on can add
        total = np.zeros(high - low, np.int64)
        i = 0
        while i < len(order) and left[i] >= floor:  # lists that can lift a document to the floor on their own
            d, s = iterators[order[i]]
            a, b = np.searchsorted(d, (low, high))
            total[d[a:b] - low] += s[a:b]
            self.looked += int(b - a)
            i += 1
        own = np.flatnonzero(total)
        score = total[own]
        for j in range(i, len(order)):
            some = score + left[j] >= floor
            own, score = own[some], score[some]
            if not len(own):
                break
            d, s = iterators[order[j]]
            a, b = np.searchsorted(d, (low, high))
            place = a + np.searchsorted(d[a:b], own + low)
            there = place < b
            there[there] = d[place[there]] == own[there] + low
            score = score + np.where(there, s[np.where(there, place, a)], 0)
            self.looked += len(own)
        some = score >= floor
        return own[some] + low, score[some]


def search(table: DataFrame, items: Items, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each task for each item."""
    held, window, share = table.sparkSession.sparkContext.broadcast(items), WINDOW, SHORT_SHARE
    columns = ["ids", "lengths", "term", "size", "doc", "count"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        best: list[list] = [[] for _ in asked.ids]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values if c in ("ids", "lengths") else batch.column(c)[i].as_buffer() for c in columns}
                ids = row["ids"]
                postings = Postings(row, asked.texts, asked.total, window)
                for q, (places, weights) in enumerate(zip(asked.places, asked.weights, strict=True)):
                    docs, scores = postings.best(places, weights, k, share)
                    if len(docs):
                        found = zip((-scores).tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)
                        best[q] = sorted(best[q] + list(found), key=lambda x: (x[0], x[1] is None, x[1] or 0))[:k]
        rows = [(asked.ids[q], d, -s) for q, own in enumerate(best) for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 3)], names=["item_id", "doc_id", "score"])

    return table.select(*columns).mapInArrow(answer, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of the highest score above 0 for each item, ties to the smaller doc_id.

    Every row of ``docs`` (doc_id, text) is a document of its own, also with an id that others have; a null doc_id comes last among equal
    scores. Rows of ``items`` (item_id, text) with one id, null included, are one item with all their terms. Null and empty texts have
    no term: such documents don't count, such items get no row. Whole texts of any length are read; lengths times documents must stay below
    1e17. Empty tables give no row. Other columns are not read.
    """
    spark = docs.sparkSession
    read = texts(docs)
    wanted = keep(item_terms(items), "items")
    size = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // BLOCK_TERMS)
    out = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        held = [(r.item_id, r.terms) for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        if not held:
            continue
        vocabulary = np.unique(np.concatenate([np.array(t, np.int64) for _, t in held]))
        table = segments(read, vocabulary)
        n, total = table.agg(F.sum("texts"), F.sum("total")).first()
        if not n:
            break
        asked = weigh(held, vocabulary, frequencies(table), n, total)
        out = out.unionByName(keep(search(table, asked, k), "found"))
    few = Window.partitionBy("item_id", "part").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    parted = out.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= k)
    last = parted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return last.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def frequencies(table: DataFrame) -> dict[int, int]:
    """Documents that hold each term, by its place in the vocabulary: sums of the segments' list sizes."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[i].as_py(), np.int32)) for c in (0, 1)], names=["term", "size"])

    rows = table.select("term", "size").mapInArrow(sizes, "term int, size int").groupBy("term").agg(F.sum("size").alias("n")).collect()
    return {r.term: r.n for r in rows}  # as many as a block of items has terms


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), i as (
  select item_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), q as (
  select item_id, term, count(*) as times from i group by all
), g as (
  select count(*)::bigint as n, sum(len(w))::bigint as l from d where len(w) > 0
), m as (
  select r, doc_id, {FLAT} + (({STEEP} * len(w)::bigint * g.n) // g.l) as m from d, g where len(w) > 0
), tf as (
  select r, term, count(*) as tf from (select r, unnest(w) as term from d) where term in (select term from q) group by all
), w as (
  select term, cast(floor({SCALE} * ln((2 * g.n + 2) / (2 * count(*) + 1))) as bigint) as w from tf, g group by term, g.n
), s as (
  select q.item_id, m.r, m.doc_id, cast(sum(q.times * w.w * (({NUMERATOR}::bigint * tf.tf) // ({SCALE} * tf.tf + {SATURATION} * m.m))) as bigint) as score
  from q join w using (term) join tf using (term) join m on m.r = tf.r group by q.item_id, m.r, m.doc_id
), k as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score from s where score > 0
)
select item_id, rank, doc_id, score from k where rank <= 10
"""
