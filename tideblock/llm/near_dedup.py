"""Near-duplicate documents by MinHash with tensored banding.

Every text has two small collections of ``groups`` group values, each value hashed from ``rows`` minimum hashes. A table key combines
one value of the first collection with one of the second, so groups**2 tables cost only 2 * groups * rows minimum hashes.
Two sets of similarity s miss each other with probability 2 * (1 - s**rows)**groups at most: 4e-4 at exactly 0.8, 1e-6 at 0.9.

1. One scan hashes the texts. Texts with the same set form a class; only its smallest id goes on.
2. Group values that only one text has can't be part of a shared key; they go. The rest are combined to keys.
3. Key sharers are joined to the smallest id of the key (no pairs); connected, they form groups in which links are looked for.
4. In a group, all full shingle sets are intersected in blocks of bounded size, and each pair of blocks gives a spanning forest of its
   links. So no link between candidates is lost, and the rows stay in proportion to the blocks.
5. Links are connected; classes bring back the copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, components, texts, unused
from tideblock.llm.words import mix, shingles, words
from tideblock.scratch import keep

BLOCK_DOCS, BLOCK_BYTES, COLUMNS = 128, 2 << 20, 8192


def _group_values(keys: np.ndarray, first: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """(documents, 2 * groups) values; documents must have shingles."""
    seeds = mix(np.arange(1, 2 * groups * rows + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(first), 2 * groups), np.uint64)
    buffer = np.empty_like(keys)
    for g in range(2 * groups):
        value = np.full(len(first), g + 1, np.uint64)
        for r in range(rows):
            np.multiply(keys, seeds[g * rows + r], out=buffer)
            value = mix(value + np.minimum.reduceat(buffer, first))
        out[:, g] = value
    return out


def sketches(docs: DataFrame, n: int, groups: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (the same for the same set; an empty set has its own) and the group values."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1))
        keys, first = shingles(w, n)
        sizes = np.diff(first)
        full = np.flatnonzero(sizes)
        values = _group_values(keys, first[:-1][full], groups, rows).view(np.int64)
        ids = batch.column(0).to_pylist()
        digest = [hashlib.blake2b(keys[a:b].tobytes() if b > a else f"empty {i}".encode(), digest_size=16).digest() for i, a, b in zip(ids, first[:-1], first[1:], strict=True)]
        offsets = np.concatenate([[0], (np.where(sizes > 0, 2 * groups, 0)).cumsum()]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(digest, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "values"])

    return docs.mapInArrow(by_slice(work), "doc_id long, n_shingles long, set_key binary, values array<long>")


def candidates(reps: DataFrame, groups: int) -> DataFrame:
    """(a, b): every text that shares a table key with another, and the smallest id with that key."""
    values = reps.select("doc_id", F.posexplode("values").alias("g", "value"))
    shared = values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    alive = values.join(shared, "value").groupBy("doc_id")
    alive = alive.agg(F.collect_list(F.when(F.col("g") < groups, F.col("value"))).alias("us"), F.collect_list(F.when(F.col("g") >= groups, F.col("value"))).alias("vs"))
    pairs = alive.select("doc_id", F.explode("us").alias("u"), "vs").select("doc_id", "u", F.explode("vs").alias("v"))
    keys = keep(pairs.select("doc_id", F.xxhash64("u", "v").alias("key")), "keys")
    lead = keys.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return keys.join(lead, "key").where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()


def links(n: int, percent: int):
    """Function of the texts of two blocks of a group (or of one): spanning forest of the links between them."""

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        ids, side = batch["doc_id"].to_numpy(), batch["block"].to_numpy()
        across = batch["p"][0].as_py() != batch["q"][0].as_py()
        column = batch["text"].combine_chunks()
        keys, first = shingles(words(column), n)
        size = np.diff(first)
        doc = np.repeat(np.arange(len(ids)), size)
        kind, at = np.unique(keys, return_inverse=True)
        shared = np.bincount(at, minlength=len(kind)) > 1
        place = shared.cumsum() - 1
        doc, at = doc[shared[at]], place[at[shared[at]]]
        order = np.argsort(at, kind="stable")
        doc, at = doc[order], at[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            has = np.zeros((len(ids), COLUMNS), np.float32)
            has[doc[a:b], at[a:b] - low] = 1
            both += has @ has.T
        union = size[:, None] + size[None, :] - both
        linked = np.triu((100 * both >= percent * union) & (both > 0), 1)
        if across:
            linked &= side[:, None] != side[None, :]
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(linked).tolist():
            if (i := find(x)) != (j := find(y)):
                root[i] = j
                out.append((x, y))
        chosen = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[chosen[:, 0]], "b": ids[chosen[:, 1]]})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 80, groups: int = 12, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id, over any number of links), kept (doc_id = component_id).

    A-Z are lower-cased; sets are of runs of ``n`` words, shorter texts are one run. Documents are linked if the intersection is at least
    ``percent`` per cent of the union. Nulls, empty texts and texts of white space have no shingle and no link. Rows of one id are one
    document: each gets its row, with the id's component. A null id is never linked: component_id is null and kept true.
    """
    docs = texts(docs, doc_id, text)
    made = keep(sketches(docs, n, groups, rows), "sketches")
    known = made.where("doc_id is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("values").alias("values"))
    reps = keep(classes.where(F.size("values") > 0), "classes")
    near = components(candidates(reps.select(F.col("rep").alias("doc_id"), "values"), groups))
    # The same join at every size: the ids in groups grow with the documents, so they are not broadcast.
    members = keep(docs.join(near.hint("merge"), F.col("doc_id") == F.col("node")).select("doc_id", "text", "root"), "members")
    sized = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks"))
    sized = keep(sized, "sizes")  # so that the join with a large group can be split
    blocks = members.join(sized, "root").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = blocks.withColumn("o", other).select("doc_id", "text", "root", "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))
    # One key, as else all pairs of blocks of a group would stay in the task that the join put the group in.
    found = pairs.withColumn("pair", F.struct("root", "p", "q")).groupBy("pair").applyInArrow(links(n, percent), "a long, b long")
    same_id = known.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x != y")
    by_id = known.join(same_id.select("doc_id"), "doc_id").join(reps.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(found.unionByName(by_id))
    merged = classes.select("set_key", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    out = known.join(merged, "set_key").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    none = made.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(none)


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) of the smallest id of each component, one row for each id. Rows without an id stay."""
    own, copies = unused(docs, "_kept"), unused(docs, "_rows")
    found = keep(near_duplicates(docs, n=n, percent=percent).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    found = found.select(F.col("doc_id").alias(own), F.col("n").alias(copies))
    rows = docs.join(found.hint("merge"), F.col("doc_id") == F.col(own)).drop(own)
    once = rows.where(F.col(copies) == 1).drop(copies)
    several = rows.where(F.col(copies) > 1).drop(copies).dropDuplicates(["doc_id"])
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws
  from documents
), s as (
  select distinct doc_id, array_to_string(case when len(ws) < 4 then ws else ws[i:i + 3] end, ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as both from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.both >= 80 * (x.n + y.n - p.both)
), r(a, b) as (
  select doc_id, doc_id from w union select r.a, e.b from r join e on r.b = e.a
), c as (
  select a as doc_id, min(b) as component_id from r group by a
)
select c.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)
"""
