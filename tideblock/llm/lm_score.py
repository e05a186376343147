"""Language-model scores of whole documents: a gated recurrent network over frequent words, corpus counts for the others.

Counts of all words come from all training documents. The network knows the most frequent words, the end of a document, and one sign for
all other words; such a word's chance is that sign's times its smoothed share of the other words' counts, with one more place for words
never seen. So every text has a chance, and chances sum to one.

The network first learns from a sample of bounded size. Then all training documents are learned in parallel, each task starting from the
same weights and carrying its own through all its documents, and the tasks' weights are averaged by the number of tokens.

The counts of the ``FREQUENT`` most frequent words go to all tasks (a fixed size). Rarer ones are joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm import recurrent
from tideblock.llm.frames import added, learned, remainder, texts
from tideblock.llm.words import Words, mix, slices, words
from tideblock.scratch import keep

CLASSES = MEMBERS = 64
FREQUENT = 1 << 18
WARM_TEXTS = 2000
FLUSH = 1 << 21
SLICE_BYTES = 6 << 20
HASHED = 1 << 13
END = np.uint64(0x0DDC0FFEEBADF00D)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words and an end for each text), and where each text's begin (one more entry than texts)."""
    w = words(column)
    first = w.first + np.arange(len(w.first))
    out = np.full(int(first[-1]), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    # Few words at a time: hashing takes eight bytes and more for each of their bytes, which then stay in a core's cache.
    some = [slice(low, low + HASHED) for low in range(0, len(w.start), HASHED)]
    out[inside] = np.concatenate([Words(w.raw, w.start[i], w.end[i], w.first).hashes() for i in some] or [w.start.view(np.uint64)[:0]])
    return out, first


def counted(docs: DataFrame) -> DataFrame:
    """word (its hash), n: the counts of all tokens of (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for low, high in slices(batch.column(1)):
                held.append(tokens(batch.column(1).slice(low, high - low))[0])
                size += len(held[-1])
                if size >= FLUSH:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return docs.mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the most frequent words, at most ``FREQUENT`` and the end, most frequent first.

    A histogram of rounded logarithms of the counts (a few thousand rows) gives the bound, so nothing is sorted as a whole.
    """
    size = F.floor(F.log2("n") * 64).cast("int")
    room, bound = FREQUENT, None
    for b, k in sorted(map(tuple, counts.groupBy(size.alias("b")).agg(F.count("*")).collect()), reverse=True):
        if k > room:
            break
        room, bound = room - k, b
    end = F.col("word") == int(END.astype(np.int64))
    top = counts.where(end if bound is None else (size >= bound) | end).toArrow()
    word, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((word, -n))
    return word[order], n[order]


class Known:
    """The frequent words' counts and the network's ids. ``words`` and ``n``: most frequent first, the end of a document among them."""

    def __init__(self, top_words: np.ndarray, n: np.ndarray, total: int, distinct: int):
        self.total, self.distinct = total, distinct
        inside = np.flatnonzero(top_words != END)[: CLASSES * MEMBERS - 2]
        self.short = np.concatenate([top_words[inside], [END]])
        counts = np.concatenate([n[inside], n[top_words == END] if (top_words == END).any() else [0]])
        self.other = len(self.short)  # the sign of all other words
        self.counts = np.concatenate([counts, [total - counts.sum()]]) + 0.5
        self.other_mass = float(total - counts.sum() + 0.5 * (distinct - len(inside) - ((top_words == END).any()) + 1))
        self.order = np.argsort(self.short)
        self.by_hash = np.argsort(top_words)
        self.words, self.n = top_words[self.by_hash], n[self.by_hash]

    def ids(self, token: np.ndarray) -> np.ndarray:
        sorted_words = self.short[self.order]
        at = np.minimum(np.searchsorted(sorted_words, token), len(sorted_words) - 1)
        return np.where(sorted_words[at] == token, self.order[at], self.other)

    def look_up(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each token, and whether it is among the frequent; an end always is."""
        end = token == END
        if not len(self.words):
            return np.zeros(len(token), np.int64), end
        at = np.minimum(np.searchsorted(self.words, token), len(self.words) - 1)
        there = self.words[at] == token
        return np.where(there, self.n[at], 0), there | end

    def start(self) -> int:
        return self.other - 1


def _texts_of(batches) -> Iterator[pa.Array]:
    for batch in batches:
        for low, high in slices(batch.column(1), SLICE_BYTES):
            yield batch.column(1).slice(low, high - low)


def _trained(weights: list[np.ndarray], known: Known, column: pa.Array, memory: list[np.ndarray]) -> int:
    token, first = tokens(column)
    recurrent.learn(weights, known.ids(token), first, known.start(), memory)
    return len(token)


def network(docs: DataFrame, known: Known) -> np.ndarray:
    """Weights learned from (doc_id, text): from a sample, then from all rows with averaged weights."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(known)

    def warm(batches: list[pa.RecordBatch]) -> bytes:
        k = held.value
        weights = recurrent.initial(k.counts, CLASSES, MEMBERS)
        memory = [np.full_like(w, 1e-4) for w in weights]
        for _ in range(2):
            for column in _texts_of(batches):
                _trained(weights, k, column, memory)
        return recurrent.packed(weights).astype(np.float32).tobytes()

    rows = docs.count()
    part = min(1.0, WARM_TEXTS / max(1, rows))
    other = F.pmod(F.xxhash64("doc_id", F.lit("warm")), F.lit(1_000_003)) / 1_000_003.0
    start = np.frombuffer(learned(docs.where(other < part), warm), np.float32)
    begun = spark.sparkContext.broadcast(start)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held.value
        weights = recurrent.unpacked(begun.value, CLASSES, MEMBERS)
        memory = [np.full_like(w, 1e-2) for w in weights]
        n = sum(_trained(weights, k, column, memory) for column in _texts_of(batches))
        total = np.append(recurrent.packed(weights).astype(np.float64), 1.0) * n
        yield pa.RecordBatch.from_pydict({"sum": pa.array([total.tobytes()], pa.binary())})

    total = added(docs.mapInArrow(whole, "sum binary"), len(start) + 1, parts=4)
    return (total[:-1] / total[-1]).astype(np.float32) if total[-1] else start


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 chances of the whole text); one row for each row.

    Learns where crc32(doc_id as text) modulo 5 is not 1; ``held_out`` are those of remainder 1 (null for a null id, which is not learned
    from). A-Z are lower-cased; words end at white space; each text, also a null or empty one, ends with a token of its own. Words are
    told apart by a 64-bit hash. Without training rows every word is unknown.
    """
    docs = texts(docs, doc_id, text)
    spark = docs.sparkSession
    training = docs.where(remainder("doc_id", 5) != 1)
    counts = keep(counted(training), "counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    known = Known(*frequent(counts), total, distinct)
    weights = network(training, known)
    held = spark.sparkContext.broadcast((known, weights))

    def keys(column: pa.Array, ids: pa.Array, token: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A key of id and text: rows with the same key are repeated rows."""
        place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
        each = mix(token + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        text_key = np.add.reduceat(each, first[:-1]) if len(column) else np.zeros(0, np.uint64)
        own = ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) + np.asarray(ids.is_null()).astype(np.uint64) * np.uint64(0xABCDEF)
        return mix(text_key ^ mix(own + np.uint64(1))).view(np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, flat = held.value
        w = recurrent.unpacked(flat, CLASSES, MEMBERS)
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                column, ids = batch.column(1).slice(low, high - low), batch.column(0).slice(low, high - low)
                token, first = tokens(column)
                unique, index = np.unique(token, return_inverse=True)
                n, there = k.look_up(unique)
                share = np.where(there, np.log10(n + 0.5), 0)[index]
                net = k.ids(unique)[index]
                chance = recurrent.log10_chances(w, net, first, k.start()) + np.where(net == k.other, share, 0)
                sums = [np.add.reduceat(x, first[:-1]) for x in (share, chance, ((n > 0) & there)[index].astype(np.int64), (net == k.other).astype(np.int64))]
                far = ~there[index]
                rare = pa.ListArray.from_arrays(np.concatenate([[0], far.cumsum()])[first].astype(np.int32), pa.array(token[far].view(np.int64)))
                columns = [ids, pa.array(keys(column, ids, token, first)), pa.array(np.diff(first)), *(pa.array(x) for x in sums), rare]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_tokens", "share", "chance", "known", "other", "rare"])

    made = keep(docs.mapInArrow(score, "doc_id long, key long, n_tokens long, share double, chance double, known long, other long, rare array<long>"), "scores")
    seldom = made.select("key", F.explode("rare").alias("word")).join(counts.hint("merge"), "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    by_text = seldom.groupBy("key").agg(F.sum(F.log10(n + 0.5)).alias("more_share"), F.count(F.when(n > 0, 1)).alias("more_known"))
    copies = made.groupBy("key").agg(F.count("*").alias("copies"))
    both = made.join(copies.join(by_text, "key"), "key", "left")  # repeated rows all sent their rare words
    more = F.coalesce(F.col("more_share") / F.col("copies"), F.lit(0.0))
    base = F.col("share") + more - F.col("n_tokens") * float(np.log10(total + 0.5 * (distinct + 1)))
    return both.select(
        "doc_id",
        (remainder("doc_id", 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("more_known") / F.col("copies"), F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("chance") + more - F.col("other") * float(np.log10(max(known.other_mass, 0.5)))).alias("score"),
    )
