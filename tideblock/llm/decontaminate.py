"""Benchmark items inside documents: MinHash containment search partitioned by size, verified by exact containment.

Items are short and documents may be long, so the similarity of their whole sets says little. Items are partitioned by their number of
shingles (classes of 32, 64, ...), and for a class of size u each document is seen as windows of 2 * u shingles, one every u. A passage
of an item's length lies in one window whole, so that their similarity is 0.19 or more at a containment of 0.8, and 64 minimum hashes
miss it with a probability of 1e-6. Windows are minima of blocks of 16 shingles, so all classes together cost one pass for each hash.

Items of up to 16 shingles are too few among a window's for that. They are looked up by shingles, and none is missed: of the s shingles of
an item of which k are asked for, any s - k + 1 have one of those found, so its s - k + 1 rarest ones among the items are enough.

Items go to the tasks in blocks of bounded size, a scan for each block. A candidate is verified against the document's full set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, texts
from tideblock.llm.words import grams, mix, shingles, words

N = 5
PERCENT = 80
UNIT = 16
HASHES = 64
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 8 << 20
FILTER_BITS = 22
_ODD = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALT = (mix(np.arange(101, HASHES + 101, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_COLUMN = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)


def _units(keys: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(blocks, hashes) minima over each block of ``UNIT`` keys of each set; set d has count[d] blocks and one key at least."""
    bounds = np.concatenate([[0], count.cumsum()])
    at = np.repeat(first[:-1], count) + UNIT * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count))
    place = np.minimum(at[None, :] + np.arange(UNIT)[:, None], np.repeat(first[1:] - 1, count)[None, :])  # a short block repeats its last key
    short = (keys >> np.uint64(32)).astype(np.uint32)[place]
    out, buffer = np.empty((len(at), HASHES), np.uint32), np.empty_like(short)
    for i, a in enumerate(_ODD):
        np.multiply(short, a, out=buffer)
        out[:, i] = np.minimum.reduce(buffer, axis=0)
    return out


class Index:
    """Shingles of the short ones of a block of items, and minimum hashes of the others by size class. ``items``: (item_id, text) rows."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int, percent: int = PERCENT):
        self.ids = [i for i, _ in items]
        self.keys, self.first = shingles(words(pa.array([t for _, t in items], pa.string())), n)
        size = np.diff(self.first)
        self._look_up(size, percent)
        kind = np.ceil(np.log2(np.maximum(size, UNIT) / UNIT)).astype(int)
        self.classes = []
        for c in np.unique(kind[size > UNIT]).tolist():
            rows = np.flatnonzero(kind == c)
            keys = np.concatenate([self.keys[self.first[r] : self.first[r + 1]] for r in rows])
            bounds = np.concatenate([[0], size[rows].cumsum()])
            count = -(-size[rows] // UNIT)
            values = np.minimum.reduceat(_units(keys, bounds, count), count.cumsum() - count, axis=0)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[((values ^ _SALT) & np.uint32(len(seen) - 1)).ravel()] = True
            values = (values.astype(np.uint64) | _COLUMN).ravel()
            order = np.argsort(values, kind="stable")
            values, owner = values[order], np.repeat(rows, HASHES)[order]
            self.classes.append((c, values, owner, seen))

    def _look_up(self, size: np.ndarray, percent: int) -> None:
        """Of each item of ``UNIT`` shingles or fewer, its rarest ones, by shingle."""
        owner = np.repeat(np.arange(len(size)), np.where(size <= UNIT, size, 0))
        keys = self.keys[np.repeat(size <= UNIT, size)]
        _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.lexsort((keys, count[inverse], owner))
        keys, owner = keys[order], owner[order]
        spare = size - np.maximum(1, -(-percent * size // 100))
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
        keys, owner = keys[rank <= spare[owner]], owner[rank <= spare[owner]]
        order = np.argsort(keys, kind="stable")
        self.short, self.short_owner = keys[order], owner[order]
        self.short_seen = np.zeros(1 << FILTER_BITS, bool)
        self.short_seen[self.short & np.uint64(len(self.short_seen) - 1)] = True

    def shared(self, item: int, keys: np.ndarray) -> tuple[int, int]:
        """How many shingles of the item are in ``keys`` (sorted), of how many."""
        own = self.keys[self.first[item] : self.first[item + 1]]
        at = np.searchsorted(keys, own)
        return int((keys[np.minimum(at, len(keys) - 1)] == own).sum()) if len(keys) else 0, len(own)


def _halved(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of neighbouring pairs of rows in each document."""
    count = (np.diff(first) + 1) // 2
    bounds = np.concatenate([[0], count.cumsum()])
    at = np.repeat(first[:-1], count) + 2 * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], count))
    return np.minimum.reduceat(values, at, axis=0), bounds


def _pairs(doc: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each document with the owners from its low to its high."""
    n = high - low
    items = owner[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)]
    return zip(np.repeat(doc, n).tolist(), items.tolist(), strict=True)


def _short(index: Index, runs: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of documents and short items, as ``candidates``."""
    at = np.flatnonzero(index.short_seen[runs & np.uint64(len(index.short_seen) - 1)])
    low, high = (np.searchsorted(index.short, runs[at], side=side) for side in ("left", "right"))
    some = high > low
    doc, low, high = np.searchsorted(first, at[some], side="right") - 1, low[some], high[some]
    order = np.lexsort((low, doc))
    doc, low, high = doc[order], low[order], high[order]
    fresh = np.ones(len(doc), bool)  # a shingle once for each document
    fresh[1:] = (doc[1:] != doc[:-1]) | (low[1:] != low[:-1])
    return set(_pairs(doc[fresh], index.short_owner, low[fresh], high[fresh]))


def candidates(index: Index, runs: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs worth verifying. Document d has the shingle hashes runs[first[d]:first[d + 1]], in text order."""
    full = np.flatnonzero(np.diff(first))
    found = _short(index, runs, first)
    if not len(full) or not index.classes:
        return found
    count = -(-np.diff(first)[full] // UNIT)
    bounds = np.concatenate([[0], count.cumsum()])
    blocks = _units(runs, np.append(first[full], first[-1]), count)
    level = 0
    for c, values, owner, seen in index.classes:
        while level < c:
            blocks, bounds = _halved(blocks, bounds)
            level += 1
        last = np.zeros(len(blocks), bool)
        last[bounds[1:] - 1] = True
        windows = np.minimum(blocks, np.where(last[:, None], blocks, np.roll(blocks, -1, axis=0)))
        row, column = np.nonzero(seen[(windows ^ _SALT) & np.uint32(len(seen) - 1)])
        hit = windows[row, column].astype(np.uint64) | _COLUMN[column]
        low, high = np.searchsorted(values, hit, side="left"), np.searchsorted(values, hit, side="right")
        some = high > low
        row, low, high = row[some], low[some], high[some]
        found.update(_pairs(full[np.searchsorted(bounds, row, side="right") - 1], owner, low, high))
    return found


def matches(index: Index, column: pa.Array, n: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(document, item, shared shingles, the item's shingles) of every pair of the containment."""
    w = words(column)
    hashes = w.hashes()
    all_runs = grams(hashes, n)
    count = np.maximum(w.counts() - n + 1, 0)
    short = (count == 0) & (w.counts() > 0)
    if short.any():  # a text of fewer words is one shingle
        keys, bounds = shingles(w, n)
        sets = [keys[bounds[d] : bounds[d + 1]] if short[d] else all_runs[w.first[d] : w.first[d] + count[d]] for d in range(w.docs)]
        runs, count = np.concatenate(sets), np.maximum(count, short)
    else:
        at = np.repeat(w.first[:-1], count) + np.arange(int(count.sum())) - np.repeat(count.cumsum() - count, count)
        runs = all_runs[at]
    first = np.concatenate([[0], count.cumsum()])
    out, kept = [], (-1, None)
    for doc, item in sorted(candidates(index, runs, first)):
        if kept[0] != doc:
            kept = (doc, np.sort(runs[first[doc] : first[doc + 1]]))
        both, size = index.shared(item, kept[1])
        if 100 * both >= percent * size:
            out.append((doc, item, both, size))
    return out


def blocks(items: DataFrame, item_id: str, text: str, n: int, percent: int) -> Iterator[Index]:
    """Indexes of blocks of items, each of bounded size."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count = max(1, -(-size[0] // BLOCK_ITEMS), -(-(size[1] or 0) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield Index([tuple(r) for r in (rows if count == 1 else rows.where(block == k)).sort("item_id").collect()], n, percent)


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: pairs where the document has ``percent`` per cent of the item's shingles or more.

    Shingles are distinct runs of ``n`` words, A-Z lower-cased; a shorter text is one as a whole. Nulls and texts without a word have none
    and match nothing. Rows of one id are rows of their own; null ids stay null. The pairs grow with the documents that hold items.
    """
    docs = texts(docs, doc_id, text)
    out = None
    for index in blocks(items, item_id, item_text, n, percent):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            found = matches(held.value, batch.column(1), n, percent)
            rows = pa.array([d for d, *_ in found], pa.int64())
            ids = pa.array([held.value.ids[i] for _, i, *_ in found], pa.int64())
            both, size = pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(rows), ids, both, size], names=["doc_id", "item_id", "shared", "item_shingles"])

        part = docs.mapInArrow(by_slice(work), "doc_id long, item_id long, shared long, item_shingles long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; filtered in place."""
    for index in blocks(items, "item_id", "text", n, percent):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            stay = np.ones(batch.num_rows, bool)
            stay[[d for d, *_ in matches(held.value, batch.column(batch.schema.get_field_index("text")), n, percent)]] = False
            return batch.filter(pa.array(stay))

        docs = docs.mapInArrow(by_slice(work), docs.schema)
    return docs


SQL = """
with t as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark
), w as (
  select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from t
), s as (
  select distinct kind, id, array_to_string(case when len(ws) < 5 then ws else ws[i:i + 4] end, ' ') as g
  from (select kind, id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (
  select id, count(*) as n from s where kind = 'b' group by id
)
select d.id as doc_id, b.id as item_id, count(*) as shared, any_value(n.n) as item_shingles, count(*) / any_value(n.n) as containment
from s d join s b on d.kind = 'd' and b.kind = 'b' and d.g = b.g join n on n.id = b.id
group by d.id, b.id having 100 * count(*) >= 80 * any_value(n.n)
"""
