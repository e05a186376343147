"""Merkle manifest of a table: a leaf for each row, a tree for each language, one root, and a proof for every row by multiproofs.

Leaves of a language stand in order of doc_id (null first, equal ones by leaf). Every 2 consecutive nodes become one until one is left;
an odd last node is hashed alone. The trees' roots, in order of language (null first, by bytes), make the tree above them likewise.

Leaves are dealt in runs of ``2 ** BITS`` aligned positions, and a run is one task's work at a time. A run hashes its own levels; only its top
goes up, and tops are dealt in runs again, so a tree of any size takes a few rounds. For the proofs each run computes the minimal union of
node coordinates that its leaves need and can't derive from each other (Octopus), fetches those few nodes once by a join, derives all
shared interior nodes itself and expands the proof of each of its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideblock.operators import ordered
from tideblock.scratch import keep

BITS = 13
TAMPERED = 7
ABOVE = ""  # key of the tree over all languages' roots; languages' keys are "0" for null and "1" with the language
NODES = "tree string, level int, pos long, hash string, lifted string, width long"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def above(nodes: list[str]) -> list[str]:
    """The next level: every 2 consecutive nodes hashed as one, an odd last one alone."""
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def missing(positions: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Octopus: the least set of (level, position) that, with the leaves at ``positions`` of ``width``, gives all their proofs."""
    out, known, level = [], np.unique(positions), 0
    while width > 1:
        other = known ^ 1
        out += [(level, p) for p in other[(other < width) & ~np.isin(other, known)].tolist()]
        known, width, level = np.unique(known >> 1), (width + 1) // 2, level + 1
    return out


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, and forged: the leaf of a tampered row, null for a row left as it is."""
    rows = docs.select(*[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")], F.col("doc_id").cast("long").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"))

    def leaf(n_chars: Column) -> Column:
        fields = [_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]
        return F.sha2(F.concat(*fields).cast("binary"), 256)

    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    forged = F.when(hit, leaf(F.col("n_chars").cast("decimal(20,0)") + 1))
    tree = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    return rows.select(tree.alias("tree"), "doc_id", leaf(F.col("n_chars")).alias("leaf"), forged.alias("forged"))


def _strings(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _raise(level: int, bits: int, inner: bool) -> Callable[[pa.Table], pa.Table]:
    """Work of one run: its top (also lifted to the height of a full run), and with ``inner`` all its nodes below the top."""

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        tree, first = group["tree"][0].as_py(), group["pos"][0].as_py()
        nodes, out, height = group["hash"].to_pylist(), [], 0
        while len(nodes) > 1:
            if inner:
                out += [(tree, level + height, (first >> height) + i, h, None, None) for i, h in enumerate(nodes)]
            nodes, height = above(nodes), height + 1
        lifted = top = nodes[0]
        for h in range(height, bits):
            if inner:
                out.append((tree, level + h, first >> h, lifted, None, None))
            lifted = digest(lifted)
        out.append((tree, -1, first >> bits, top, lifted, group.num_rows))
        return _strings(out, NODES)

    return work


def grow(nodes: DataFrame, bits: int, inner: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tree, hash, width) of the trees' roots, (tree, level, pos, hash) of inner nodes, and (tree, run) of the first round.

    ``nodes`` has tree, pos, hash. Inner nodes are those from level ``bits`` up, or with ``inner`` all. Nodes lifted above the root
    of a tree of one run may be listed too; nothing asks for them.
    """
    roots, kept, runs, level = [], [], None, 0
    while True:
        made = keep(nodes.groupBy("tree", F.shiftright("pos", bits).alias("run")).applyInArrow(_raise(level, bits, inner or level > 0), NODES), "merkle")
        kept.append(made.where("level >= 0").select("tree", "level", "pos", "hash"))
        tops = made.where("level < 0")
        widths = tops.groupBy("tree").agg(F.count("*").alias("tops"), F.sum("width").alias("width"), F.first("hash").alias("hash"))
        widths = keep(widths, "merkle_widths")
        if runs is None:
            runs, sizes = tops.select("tree", F.col("pos").alias("run")), widths.select("tree", "width")
        roots.append(widths.where("tops = 1").select("tree", "hash"))
        if widths.where("tops > 1").isEmpty():
            break
        nodes = tops.join(widths.where("tops > 1").select("tree"), "tree", "left_semi").select("tree", "pos", F.col("lifted").alias("hash"))
        level += bits
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(roots).join(sizes, "tree"), union(kept), runs


def manifest(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    A proof is a row's siblings from its leaf up to the root; ``proof_sha256`` is their digest. ``folded_root`` follows from the
    tampered row's leaf, or the row's own, and the original siblings; ``verified`` says whether that is the root.

    Nulls in every column have their own mark in a leaf; a null doc_id comes first in its language and isn't tampered with. Repeated rows are
    leaves each. Texts of any length are hashed whole. A single row is its own root, with the digest of nothing as its proof; an empty
    table gives no row. Other columns are not read.
    """
    bits = BITS if bits is None else bits
    placed = leaves(docs).withColumn("tie", F.monotonically_increasing_id())  # equal leaves are alike, but may be split
    numbered = ordered.over(placed, ["tree"], ["doc_id", "leaf", "tie"], n=ordered.row_count())
    rows = keep(numbered.select("tree", "doc_id", "leaf", "forged", (F.col("n") - 1).alias("pos")), "leaves")
    subroots, nodes, runs = grow(rows.select("tree", "pos", F.col("leaf").alias("hash")), bits, False)
    ranked = ordered.over(subroots.withColumn("all", F.lit(ABOVE)), ["all"], ["tree"], n=ordered.row_count())
    ranked = keep(ranked.select("tree", "hash", "width", (F.col("n") - 1).alias("rank")), "subroots")
    root, upper, _ = grow(ranked.select(F.lit(ABOVE).alias("tree"), F.col("rank").alias("pos"), "hash"), bits, True)
    top = root.select("hash", "width").first()  # one row, none for an empty table
    sums = [F.lit(top.hash if top else None).alias("root"), F.lit(top.width if top else 0).cast("long").alias("trees")]
    wanted = keep(runs.join(ranked.withColumnRenamed("hash", "subroot"), "tree").select("*", *sums), "runs")

    def ask(batches):
        for batch in batches:
            out = []
            for r in batch.select(["tree", "run", "width", "rank", "trees"]).to_pylist():
                own = np.arange(r["run"] << bits, min(r["width"], (r["run"] + 1) << bits))
                out += [(r["tree"], r["run"], r["tree"], level, pos) for level, pos in missing(own, r["width"])]
                out += [(r["tree"], r["run"], ABOVE, level, pos) for level, pos in missing(np.array([r["rank"]]), r["trees"])]
            yield from _strings(out, "tree string, run long, at string, level int, pos long").to_batches()

    asked = wanted.mapInArrow(ask, "tree string, run long, at string, level int, pos long")
    coordinates = nodes.unionByName(upper).withColumnRenamed("tree", "at")
    found = asked.join(coordinates, ["at", "level", "pos"]).groupBy("tree", "run").agg(F.collect_list(F.struct((F.col("at") == ABOVE).alias("over"), "level", "pos", "hash")).alias("nodes"))
    fetched = wanted.join(found, ["tree", "run"], "left")
    own = rows.withColumn("run", F.shiftright("pos", bits))
    return own.groupBy("tree", "run").cogroup(fetched.groupBy("tree", "run")).applyInArrow(_expand, PROOFS)


def _expand(run: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs and folds of one run's leaves from its own levels and the fetched nodes."""
    run, info = run.sort_by("pos"), fetched.to_pylist()[0]
    ids, own, forged = (run[c].to_pylist() for c in ("doc_id", "leaf", "forged"))
    held = {(n["over"], n["level"], n["pos"]): n["hash"] for n in info["nodes"] or ()}
    first, width, shared = run["pos"][0].as_py(), info["width"], []
    # Levels while the run holds more than one node: nodes that its leaves share.
    level, nodes, count = 0, own, width
    while len(nodes) > 1:
        shared.append(nodes)
        nodes, level, count = above(nodes), level + 1, (count + 1) // 2
    # One node is left: from here the path is the same for all leaves of the run.
    path = []
    for over, pos, size, low in ((False, first >> level, count, level), (True, info["rank"], info["trees"], 0)):
        while size > 1:
            path.append((pos & 1, held[over, low, pos ^ 1] if pos ^ 1 < size else ""))
            pos, size, low = pos >> 1, (size + 1) // 2, low + 1
    tail = "".join(s for _, s in path)

    def fold(node: str) -> str:
        for right, s in path:
            node = digest(s + node if right else node + s)
        return node

    honest, out = fold(nodes[0]), []
    for i, (doc_id, leaf, other) in enumerate(zip(ids, own, forged, strict=True)):
        siblings = [(i >> h & 1, level[i >> h ^ 1] if i >> h ^ 1 < len(level) else "") for h, level in enumerate(shared)]
        folded = honest
        if other is not None:
            node = other
            for right, s in siblings:
                node = digest(s + node if right else node + s)
            folded = fold(node)
        out.append((doc_id, leaf, info["subroot"], info["root"], digest("".join(s for _, s in siblings) + tail), folded, folded == info["root"]))
    return _strings(out, PROOFS)


SQL = """
with recursive raw as (
  select doc_id, case when lang is null then '0' else '1' || lang end as tree, coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') as a,
    coalesce(strlen(source) || ':' || source, '-') as b, coalesce(strlen(lang) || ':' || lang, '-') as c, n_chars,
    coalesce(strlen(text) || ':' || text, '-') as e,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))),
      lambda s, x: list_reduce([xor(s, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384::bigint) else y // 2 end)), 4294967295::bigint) as crc
  from documents
), hashed as (
  select doc_id, tree, sha256(a || b || c || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || e) as leaf,
    case when crc % 7 = 0 and n_chars is not null then sha256(a || b || c || strlen(cast(n_chars::hugeint + 1 as varchar)) || ':' || (n_chars::hugeint + 1) || e) end as forged
  from raw
), d as (
  select *, row_number() over () as k, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as width from hashed
), t as (
  select tree, 0 as level, pos, leaf as h, width from d
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((width + 1) // 2) from t where width > 1 group by tree, level, pos // 2
), sub as (
  select tree, h, row_number() over (order by encode(tree)) - 1 as pos, count(*) over () as width from t where width = 1
), u as (
  select 0 as level, pos, h, width from sub
  union all
  select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), any_value((width + 1) // 2) from u where width > 1 group by level, pos // 2
), steps as (
  select d.k, 0 as stage, w.level, (d.pos >> w.level) % 2 as side, s.h from d
    join (select distinct tree, level, width from t where width > 1) w on w.tree = d.tree
    left join t s on s.tree = d.tree and s.level = w.level and s.pos = xor(d.pos >> w.level, 1)
  union all
  select d.k, 1, w.level, (sub.pos >> w.level) % 2, s.h from d join sub on sub.tree = d.tree
    cross join (select distinct level, width from u where width > 1) w
    left join u s on s.level = w.level and s.pos = xor(sub.pos >> w.level, 1)
), numbered as (
  select *, row_number() over (partition by k order by stage, level) as step from steps
), f as (
  select k, 0::bigint as step, coalesce(forged, leaf) as h from d
  union all
  select f.k, n.step, sha256(case when n.side = 1 then coalesce(n.h, '') || f.h else f.h || coalesce(n.h, '') end) from f join numbered n on n.k = f.k and n.step = f.step + 1
), proof as (
  select k, sha256(coalesce(string_agg(h, '' order by step), '')) as proof from numbered group by k
)
select d.doc_id, d.leaf, sub.h as subroot, r.h as root, coalesce(p.proof, sha256('')) as proof_sha256, l.h as folded_root, l.h = r.h as verified
from d join sub on sub.tree = d.tree cross join (select h from u where width = 1) r left join proof p on p.k = d.k
  join (select k, arg_max(h, step) as h from f group by k) l on l.k = d.k
"""
