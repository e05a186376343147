"""Repeated passages: every word covered by a run of ``window`` words that also starts in a document of a smaller id is removed.

1. One scan gives each document's words a digest. Documents with the same words form a class, of which only the first goes on.
2. The anchor of a window is the smallest hash among its short word runs. Neighbouring windows share their anchor, so there are about
   five times fewer anchors than words; equal windows have equal anchors. Anchors of two classes or more are counted in one shuffle, in
   which a task sends an anchor once with all its classes.
3. Recurring anchors go back to the first document of each class, which cuts out the phrases around them: the words of all windows with
   that anchor. An anchor of very many phrases, in many classes or many times in few, gives one phrase to a window, so that they spread
   over shards.
4. Phrases go to shards by anchor, each with its smallest and largest id. A shard confirms windows that recur in other documents by
   their words, compiles an Aho-Corasick automaton of them, and streams all phrases of the shard through it: the smallest id of each window.
5. Those return to the documents, which drop the covered words.

Every document's windows meet their shard, and no document is streamed through the automata of others, so the work follows the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, texts, unused
from tideblock.llm.words import Words, grams, mix, slices, words
from tideblock.scratch import keep

WINDOW = 13
ANCHOR = 4
FLUSH = 1 << 20
SHARD_PHRASES = 20_000
HOT = SHARD_PHRASES  # phrases of an anchor beyond which they don't fit one automaton
CHUNK_WINDOWS = 16
NEVER = (1 << 63) - 1


class Joined:
    """Words of each text joined by one space: bytes, and where word i begins and ends in them."""

    def __init__(self, w: Words):
        size = w.end - w.start
        room = size + 1
        self.start = np.concatenate([[0], room.cumsum()[:-1]]) if len(size) else np.zeros(0, np.int64)
        self.end = self.start + size
        out = np.full(int(room.sum()), 0x20, np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(size.cumsum() - size, size)
        out[inside + np.repeat(self.start, size)] = w.raw[inside + np.repeat(w.start, size)]
        self.data = out.tobytes()

    def run(self, low: int, high: int) -> bytes:
        """Words low to high - 1."""
        return self.data[self.start[low] : self.end[high - 1]] if high > low else b""


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of every window that lies in one document."""
    short = min(ANCHOR, window)
    runs = grams(w.hashes(), short)
    width = window - short + 1
    best = _smallest(runs, width) if len(runs) >= width else runs[:0]
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    at = np.repeat(w.first[:-1], count) + np.arange(int(count.sum())) - np.repeat(count.cumsum() - count, count)
    return at, best[at]


def _digest(j: Joined, w: Words) -> list[bytes]:
    first = w.first.tolist()
    return [hashlib.sha256(j.run(a, b)).digest() for a, b in zip(first[:-1], first[1:], strict=True)]


def _class_of(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8] for x in digests), "<i8")


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, digest of the words."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column(1), fold=False)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts()), pa.array(_digest(Joined(w), w), pa.binary())], names=["doc_id", "n_words", "digest"])

    return docs.mapInArrow(by_slice(work), "doc_id long, n_words long, digest binary")


def recurring(docs: DataFrame, window: int) -> DataFrame:
    """class, anchor, hot, times: the anchors that two classes or more have. ``times`` sums up to the phrases of all, a class's copies once in a part."""

    def emit(anchor: list[np.ndarray], kind: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        a, c, k = np.concatenate(anchor), np.concatenate(kind), np.concatenate(times)
        order = np.lexsort((c, a))
        a, c, k = a[order], c[order], k[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        a, c, k = a[fresh], c[fresh], np.maximum.reduceat(k, np.flatnonzero(fresh))
        head = np.ones(len(a), bool)
        head[1:] = a[1:] != a[:-1]
        more = np.diff(np.append(np.flatnonzero(head), len(a))) - 1
        offsets = np.concatenate([[0], 8 * more.cumsum()]).astype(np.int32)
        rest = pa.Array.from_buffers(pa.binary(), len(more), [pa.py_buffer(np.packbits(more > 0, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(c[~head].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(a[head].view(np.int64)), pa.array(c[head]), rest, pa.array(np.add.reduceat(k, np.flatnonzero(head)))], names=["anchor", "class", "more", "times"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, kind, times, held = [], [], [], 0
        for batch in batches:
            column = batch.column(1)
            for low, high in slices(column):
                w = words(column.slice(low, high - low), fold=False)
                at, best = anchors(w, window)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
                    own = _class_of(_digest(Joined(w), w))
                    start = np.flatnonzero(new)
                    chunks = -(-np.diff(np.append(start, len(at))) // CHUNK_WINDOWS)
                    a, doc = best[start], np.searchsorted(w.first, at[start], side="right") - 1
                    order = np.lexsort((a, doc))
                    a, doc = a[order], doc[order]
                    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])))
                    anchor.append(a[first])
                    kind.append(own[doc[first]])
                    times.append(np.add.reduceat(chunks[order], first))
                    held += len(first)
                if held >= FLUSH:
                    yield emit(anchor, kind, times)
                    anchor, kind, times, held = [], [], [], 0
        if held:
            yield emit(anchor, kind, times)

    sent = docs.mapInArrow(scan, "anchor long, class long, more binary, times long")
    over = "over (partition by anchor)"
    found = sent.selectExpr(
        "anchor", "class", "more", "times", f"min(class) {over} < max(class) {over} or count(more) {over} > 0 as several", f"sum(times) {over} > {HOT} as hot"
    ).where("several")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(2).fill_null(b"")
            n = pa.compute.binary_length(more).to_numpy().astype(np.int64) // 8
            rest = np.frombuffer(b"".join(more.to_pylist()), "<i8")
            row = np.concatenate([np.arange(len(n)), np.repeat(np.arange(len(n)), n)])
            kind = np.concatenate([batch.column(1).to_numpy(), rest])
            yield pa.RecordBatch.from_arrays([pa.array(kind), batch.column(0).take(pa.array(row)), batch.column(3).take(pa.array(row)), pa.array(np.append(batch.column(4).to_numpy(), np.zeros(len(rest), np.int64)))], names=["class", "anchor", "hot", "times"])

    return found.select("anchor", "class", "more", "hot", "times").mapInArrow(unpack, "class long, anchor long, hot boolean, times long")


def _phrases(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(shard key, id, words, first word) of every phrase of the rows (doc_id, text, digest, cold, hot)."""
    w = words(batch.column(1), fold=False)
    j = Joined(w)
    same = [a == b for a, b in zip(_digest(j, w), batch.column(2).to_pylist(), strict=True)]  # else another row of the same id
    at, best = anchors(w, window)
    best = best.view(np.int64)
    low = np.searchsorted(at, w.first)
    ids = batch.column(0).to_pylist()
    whole = mix(grams(w.hashes(), window)).view(np.int64) if len(w.start) >= window else np.zeros(0, np.int64)
    for d in range(w.docs):
        if not same[d]:
            continue
        a, b = low[d], low[d + 1]
        mine = best[a:b]
        hot, cold = (np.isin(mine, batch.column(k)[d].values.to_numpy(zero_copy_only=False)) for k in (4, 3))
        for s in (np.flatnonzero(hot) + a).tolist():
            first = int(at[s])
            yield int(whole[first]), ids[d], j.run(first, first + window), first - int(w.first[d])
        cut = np.ones(len(mine) + 1, bool)
        cut[1:-1] = (mine[1:] != mine[:-1]) | (cold[1:] != cold[:-1])
        edges = np.flatnonzero(cut).tolist()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if cold[x]:
                for s in range(x, y, CHUNK_WINDOWS):
                    first, last = int(at[a + s]), int(at[a + min(y, s + CHUNK_WINDOWS) - 1]) + window
                    yield int(mine[s]), ids[d], j.run(first, last), first - int(w.first[d])


def _key(phrase: bytes) -> int:
    x = xxhash.xxh3_64_intdigest(phrase)
    return x - (1 << 64) if x >> 63 else x


def phrases(held: DataFrame, window: int) -> DataFrame:
    """shard_key, phrase, lo, hi: each phrase with the smallest and largest id that a part of the rows has it in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, bytes], list[int]] = {}

        def emit() -> pa.RecordBatch:
            keys, ends = list(found), list(found.values())
            return pa.RecordBatch.from_pydict({"shard_key": pa.array([k for k, _ in keys], pa.int64()), "phrase": pa.array([p for _, p in keys], pa.binary()), "lo": pa.array([x for x, _ in ends], pa.int64()), "hi": pa.array([x for _, x in ends], pa.int64())})

        for batch in batches:
            for low, high in slices(batch.column(1)):
                for key, doc, phrase, _ in _phrases(batch.slice(low, high - low), window):
                    ends = found.get((key, phrase))
                    if ends is None:
                        found[(key, phrase)] = [doc, doc]
                    elif doc < ends[0]:
                        ends[0] = doc
                    elif doc > ends[1]:
                        ends[1] = doc
                if len(found) > 50_000:
                    yield emit()
                    found.clear()
        if found:
            yield emit()

    return held.mapInArrow(scan, "shard_key long, phrase binary, lo long, hi long")


def places(held: DataFrame, window: int) -> DataFrame:
    """shard_key, phrase_key, doc_id, at (first word): every occurrence of a phrase."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(key, _key(phrase), doc, at) for key, doc, phrase, at in _phrases(batch, window)]
        columns = zip(*rows, strict=True) if rows else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["shard_key", "phrase_key", "doc_id", "at"])

    return held.mapInArrow(by_slice(work), "shard_key long, phrase_key long, doc_id long, at long")


def locate(rows: list[tuple[bytes, int, int]], window: int) -> Iterator[tuple[int, list[int]]]:
    """For each phrase (words, lo, hi) with a recurring window: its place in the list, and the smallest id of each of its windows."""
    code: dict[bytes, str] = {}
    coded = []
    for phrase, _, _ in rows:
        signs = []
        for word in phrase.split(b" "):
            sign = code.get(word)
            if sign is None:
                n = len(code) + 1
                sign = code[word] = chr(n if n < 0xD800 else n + 0x800)
            signs.append(sign)
        coded.append("".join(signs))
    ends: dict[str, list[int]] = {}
    for text, (_, lo, hi) in zip(coded, rows, strict=True):
        for i in range(len(text) - window + 1):
            seen = ends.get(text[i : i + window])
            if seen is None:
                ends[text[i : i + window]] = [lo, hi]
            else:
                if lo < seen[0]:
                    seen[0] = lo
                if hi > seen[1]:
                    seen[1] = hi
    automaton = ahocorasick.Automaton()
    for text, (lo, hi) in ends.items():
        if lo < hi:
            automaton.add_word(text, lo)
    if not len(automaton):
        return
    automaton.make_automaton()
    for k, text in enumerate(coded):
        least = [NEVER] * (len(text) - window + 1)
        for end, lo in automaton.iter(text):
            least[end - window + 1] = lo
        if min(least) < rows[k][2]:
            yield k, least


def located(sent: DataFrame, window: int, shards: int) -> DataFrame:
    """shard_key, phrase_key, least: the smallest id of each window of a phrase."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = table["shard_key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        table, keys = table.take(pa.array(order)), keys[order]
        low = 0
        while low < len(keys):  # one automaton for about SHARD_PHRASES phrases; those of a key stay together
            high = int(np.searchsorted(keys, keys[min(low + SHARD_PHRASES, len(keys)) - 1], side="right"))
            part = table.slice(low, high - low)
            merged: dict[tuple[int, bytes], list[int]] = {}
            for key, phrase, lo, hi in zip(*(part[c].to_pylist() for c in ("shard_key", "phrase", "lo", "hi")), strict=True):
                ends = merged.setdefault((key, phrase), [lo, hi])
                ends[0], ends[1] = min(lo, ends[0]), max(hi, ends[1])
            names = list(merged)
            found = list(locate([(p, *merged[(k, p)]) for k, p in names], window))
            if found:
                yield pa.RecordBatch.from_pydict(
                    {"shard_key": pa.array([names[k][0] for k, _ in found], pa.int64()), "phrase_key": pa.array([_key(names[k][1]) for k, _ in found], pa.int64()), "least": pa.array([x for _, x in found], pa.list_(pa.int64()))}
                )
            low = high

    return sent.repartition(shards, "shard_key").mapInArrow(scan, "shard_key long, phrase_key long, least array<long>")


class Found:
    """Decisions on a set of documents: ``made`` (doc_id, n_words, digest, rep) and ``cuts`` (doc_id, starts), with ``held`` the texts of cut ones."""

    def __init__(self, docs: DataFrame, window: int):
        made = keep(sequences(docs), "sequences")
        known = made.where("doc_id is not null")
        classes = keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")  # so that a large class can be split in joins
        lists = [F.collect_list(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot")]
        n_phrases = F.sum(F.col("times") * F.when(F.col("hot"), 8).otherwise(1)).alias("n_phrases")
        again = keep(recurring(docs.where("doc_id is not null"), window).groupBy("class").agg(*lists, n_phrases), "anchors")
        little_endian = F.conv(F.concat(*[F.substring(F.hex("digest"), 2 * i - 1, 2) for i in range(8, 0, -1)]), 16, -10).cast("long")
        firsts = classes.select("digest", "rep", little_endian.alias("class")).join(again.drop("n_phrases"), "class")
        self.held = keep(docs.join(firsts.drop("class").withColumnRenamed("rep", "_rep").hint("merge"), F.col("doc_id") == F.col("_rep")).select("doc_id", "text", "digest", "cold", "hot"), "held")
        n = again.agg(F.sum("n_phrases")).first()[0] or 0
        shards = max(docs.sparkSession.sparkContext.defaultParallelism, int(n) // SHARD_PHRASES + 1)
        known_windows = located(phrases(self.held, window), window, shards)
        seen = places(self.held, window).join(known_windows, ["shard_key", "phrase_key"])
        starts = F.expr("filter(transform(least, (m, i) -> if(m < doc_id, at + i, null)), x -> x is not null)")
        cuts = seen.select("doc_id", starts.alias("starts")).where("size(starts) > 0").groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
        self.cuts = keep(cuts, "cuts")
        self.made = made
        self.classes = classes


def kept_mask(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's words stay."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n_words), -1)
    return edge[:-1].cumsum() == 0


def _kept(batch: pa.RecordBatch, text: int, starts: int, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, words removed, kept words) of each row."""
    w = words(batch.column(text), fold=False)
    j = Joined(w)
    for d in range(w.docs):
        low, high = int(w.first[d]), int(w.first[d + 1])
        stay = kept_mask(high - low, batch.column(starts)[d].values.to_numpy(zero_copy_only=False), window)
        edges = np.flatnonzero(np.diff(stay, prepend=False, append=False)) + low
        yield high - low, int((~stay).sum()), b" ".join(j.run(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by one space); one row for each row of ``docs``.

    Words are compared as they are, and windows on the input. Nulls, empty texts and texts of white space have no word. Rows of one id
    are one document, which is no smaller than itself. A null id has no order: nothing is removed and it is no one's source.
    """
    docs = texts(docs, doc_id, text)
    f = Found(docs, window)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(_kept(batch, 1, 3, window))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r for _, r, _ in rows], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, _, t in rows], pa.string())], names=["doc_id", "digest", "removed", "sha"])

    cut = f.held.select("doc_id", "text", "digest").join(f.cuts, "doc_id").mapInArrow(by_slice(work), "doc_id long, digest binary, removed long, sha string").dropDuplicates(["doc_id", "digest"])
    all_rows = f.made.where("doc_id is not null").join(f.classes, "digest").join(cut, ["doc_id", "digest"], "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= window)
    out = all_rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    return out.unionByName(f.made.where("doc_id is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256")))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all rows and columns, with the repeated words taken out of ``text`` and ``n_chars`` counted anew.

    Untouched texts stay as they are; others are their kept words joined by one space, empty if none is left.
    """
    f = Found(texts(docs), window)
    copies = f.made.join(f.classes, "digest").where(f"doc_id > rep and n_words >= {window}").select("doc_id", "digest", F.sequence(F.lit(0).cast("long"), F.col("n_words") - window).alias("starts"))
    firsts = f.cuts.join(f.held.select("doc_id", "digest").distinct(), "doc_id").select("doc_id", "digest", "starts")
    cuts = copies.unionByName(firsts).groupBy("doc_id").agg(F.collect_list(F.struct("digest", "starts")).alias("cuts"))
    own = unused(docs, "_cut_id")
    cuts = cuts.select(F.col("doc_id").alias(own), F.col("cuts").alias(unused(docs, "_cuts")))
    columns = docs.columns
    wide = docs.join(cuts.hint("merge"), F.col("doc_id").cast("long") == F.col(own), "left").drop(own)
    place = wide.columns.index("text")
    chars = wide.columns.index("n_chars") if "n_chars" in columns else None

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = batch.column(batch.num_columns - 1)
        rows = np.flatnonzero(~np.asarray(cut.is_null()))
        if not len(rows):
            return batch.select(columns)
        part = batch.take(pa.array(rows))
        w = words(part.column(place), fold=False)
        digests = _digest(Joined(w), w)
        starts = [next((x["starts"] for x in c if x["digest"] == d), []) for c, d in zip(part.column(part.num_columns - 1).to_pylist(), digests, strict=True)]
        asked = pa.RecordBatch.from_arrays([part.column(place), pa.array(starts, pa.list_(pa.int64()))], names=["text", "starts"])
        new, size = batch.column(place).to_pylist(), batch.column(chars).to_pylist() if chars is not None else None
        for row, (_, removed, text) in zip(rows.tolist(), _kept(asked, 0, 1, window), strict=True):
            if removed:
                new[row] = text.decode("utf-8")
                if size is not None:
                    size[row] = len(new[row])
        out = [batch.column(i) for i in range(len(columns))]
        out[place] = pa.array(new, batch.column(place).type)
        if size is not None:
            out[chars] = pa.array(size, batch.column(chars).type)
        return pa.RecordBatch.from_arrays(out, names=columns)

    return wide.mapInArrow(by_slice(work), docs.schema)


SQL = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), x as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)
), m as (
  select g, min(doc_id) as lo from x group by g
), c as (
  select distinct x.doc_id, x.i + j.j as k from x join m using (g), (select unnest(range(13)) as j) j where m.lo < x.doc_id
), v as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from w
), t as (
  select v.doc_id, count(*) as n, count(c.k) as r, string_agg(v.word, ' ' order by v.k) filter (c.k is null) as kept
  from v left join c on c.doc_id = v.doc_id and c.k = v.k group by v.doc_id
)
select w.doc_id, coalesce(t.n, 0) as n_words, coalesce(t.r, 0) as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256 from w left join t using (doc_id)
"""
