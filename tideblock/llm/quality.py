"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's n-grams are of one and two words: as they are (A-Z lower-cased), and as shapes, in which letters, capitals and digits are
one sign each and runs of a sign are one. A word that repeats the one before forms one n-gram for all words. A feature's value is its
share of the text's n-grams, so a score is one gather and one sum over the words of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, learned, remainder, stratified, texts
from tideblock.llm.ftrl import Learner, chances
from tideblock.llm.words import _BYTE, _ODD, mix, powers, words

BITS = 18
SCALE = 24.0
PER_LABEL = 3000
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_REPEAT = np.uint64(1)


def _shapes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's shape."""
    size = end - start
    at = np.concatenate([[0], size[:-1].cumsum()])
    kind = _SHAPE[raw[np.arange(int(size.sum())) - np.repeat(at - start, size)]]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at] = True
    kept = np.flatnonzero(new)
    first = np.searchsorted(kept, at)
    inside = np.arange(len(kept)) - np.repeat(first, np.diff(np.append(first, len(kept))))
    return mix(np.add.reduceat(_BYTE[kind[kept]] * powers(int(inside.max()) + 1)[inside], first))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, four to a word, and the first word of each text (one more entry than texts)."""
    w = words(column, fold=False)
    if not len(w.start):
        return np.zeros((0, 4), np.int64), w.first
    lexical, shape = words(column).hashes(), _shapes(w.raw, w.start, w.end)
    opens = np.zeros(len(lexical), bool)
    opens[w.first[:-1][np.diff(w.first) > 0]] = True
    before, shape_before = np.roll(lexical, 1), np.roll(shape, 1)
    before[opens] = shape_before[opens] = 0
    pair = np.where(before == lexical, _REPEAT, before * _ODD + lexical)
    out = np.stack([lexical, pair, shape + np.uint64(7), shape_before * _ODD + shape * np.uint64(3)], axis=1)
    return (mix(out) >> np.uint64(64 - BITS)).astype(np.int64), w.first


def train(batches: list[pa.RecordBatch], epochs: int = 3) -> bytes:
    """float32 weights, the bias last. Columns: doc_id, text, label. Without rows all weights are 0."""
    rows = []
    for batch in batches:
        buckets, first = features(batch.column(1))
        for i, label in enumerate(batch.column(2).to_pylist()):
            index, n = np.unique(buckets[first[i] : first[i + 1]], return_counts=True)
            rows.append((index, SCALE * n / max(1, n.sum()), label))
    learner, random = Learner(1 << BITS), np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            learner.learn(*rows[i])
    return learner.weights()[:, 0].astype(np.float32).tobytes()


def model(docs: DataFrame, labels: DataFrame, learn_from, label: str = "quality", per_label: int = PER_LABEL):
    """Broadcast weights, learned from at most about ``per_label`` texts of each label.

    They are chosen by a hash of the id from the rows where ``learn_from`` (a condition on doc_id) holds. Labels other than 0 and 1, and
    labels of ids without a row, are not used. Without any label all weights are 0.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)").where(learn_from)
    chosen = stratified(known, "_y", "doc_id", per_label)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "_y")  # at most about 2 * per_label ids
    return docs.sparkSession.sparkContext.broadcast(np.frombuffer(learned(sample, train), np.float32))


def logits(w: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 and number of words of each text."""
    buckets, first = features(column)
    run = np.concatenate([[0.0], w[buckets].sum(axis=1, dtype=np.float64).cumsum()])
    n = np.diff(first)
    return w[-1] + SCALE * (run[first[1:]] - run[first[:-1]]) / np.maximum(1, 4 * n), n


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted; one row for each row of ``docs``, from the whole text alone.

    Learns where crc32(doc_id as text) modulo 3 is not 1; ``held_out`` are the others (null for a null id). Null and empty texts get the
    score of the bias; without any label all scores are 0.5.
    """
    docs = texts(docs, doc_id, text)
    held = model(docs, labels, remainder("doc_id", 3) != 1, **options)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(chances(logits(held.value, batch.column(1))[0][:, None])[:, 0])], names=["doc_id", "score"])

    out = docs.mapInArrow(by_slice(work), "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.5 or more, and those without a word. Filtered in place, without a join."""
    held = model(texts(docs), labels, remainder("doc_id", 3) != 1, **options)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        logit, n = logits(held.value, batch.column(batch.schema.get_field_index("text")))
        return batch.filter(pa.array((logit >= 0) | (n == 0)))

    return docs.mapInArrow(by_slice(work), docs.schema)
