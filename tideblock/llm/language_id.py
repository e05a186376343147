"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to three characters are hashed; what is no letter counts as a space, letters are lower-cased. Document frequencies come
from all rows that may be learned from. Weights are learned with follow-the-regularised-leader updates under L1 and L2 penalties on a
sample of bounded size for each language; a temperature is fitted on a fifth of it that the weights haven't seen.
"""

from __future__ import annotations

import pickle
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import by_slice, learned, remainder, stratified, summed, texts
from tideblock.llm.ftrl import Learner, chances
from tideblock.llm.words import slices

BITS = 16
SCALE = 32.0
PER_LANGUAGE = 1500
UNKNOWN = "und"
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (letters lower-cased, all else a space), where each text's begin (one more entry than texts), letters in each text."""
    low = [(t or "").lower() for t in column.to_pylist()]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).copy()
    letter = _letters()[np.minimum(points, 0xFFFF)]
    for high in np.unique(points[points > 0xFFFF]).tolist():
        letter[points == high] = chr(high).isalpha()
    points[~letter] = 32
    run = np.concatenate([[0], letter.cumsum()])
    return points, first, run[first[1:]] - run[first[:-1]]


def buckets(points: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and where each text's begin."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    key = np.full(len(points) - n + 1, 0x9E3779B9 * n & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        key += points[i : len(points) - n + 1 + i] * _FACTORS[i]
    key ^= key >> np.uint32(15)
    key *= _FACTORS[0]
    at = np.repeat(first[:-1] - (count.cumsum() - count), count) + np.arange(int(count.sum()))
    return (key[at] >> np.uint32(32 - BITS)).astype(np.int64), np.concatenate([[0], count.cumsum()])


def document_frequency(docs: DataFrame) -> np.ndarray:
    """Texts with each bucket, and last the number of texts, over all rows of (doc_id, text)."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        column = batch.column(1)
        for low, high in slices(column):
            points, first, _ = characters(column.slice(low, high - low))
            parts = [buckets(points, first, n) for n in (1, 2, 3)]
            for a in range(0, high - low, 64):
                b = min(a + 64, high - low)
                seen = np.zeros((b - a, 1 << BITS), bool)
                for key, bounds in parts:
                    own = key[bounds[a] : bounds[b]]
                    seen[np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1])), own] = True
                total[:-1] += seen.sum(axis=0)
            total[-1] += high - low

    return summed(docs, add, (1 << BITS) + 1)


def train(batches: list[pa.RecordBatch], idf: np.ndarray, epochs: int = 2) -> bytes:
    """Pickled (languages, float32 weights with idf folded in, bias, temperature). Columns: doc_id, text, language."""
    rows, names = [], []
    for batch in batches:
        for low, high in slices(batch.column(1)):
            points, first, letters = characters(batch.column(1).slice(low, high - low))
            parts = [buckets(points, first, n) for n in (1, 2, 3)]
            for d, name in enumerate(batch.column(2).slice(low, high - low).to_pylist()):
                if letters[d]:
                    index, n = np.unique(np.concatenate([k[b[d] : b[d + 1]] for k, b in parts]), return_counts=True)
                    rows.append((index, SCALE * n / n.sum() * idf[index]))
                    names.append(name)
    languages = sorted(set(names))
    if not languages:
        return pickle.dumps(([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0))
    label = [languages.index(n) for n in names]
    random = np.random.default_rng(7)
    order = random.permutation(len(rows))
    seen, unseen = order[len(order) // 5 :], order[: len(order) // 5]
    learner = Learner(1 << BITS, max(2, len(languages)), l1=0.02, l2=0.02)
    for _ in range(epochs):
        for i in random.permutation(seen):
            learner.learn(*rows[i], label[i])
    w = learner.weights()[:, : len(languages)]
    logit = np.array([rows[i][1] @ w[:-1][rows[i][0]] + w[-1] for i in unseen]).reshape(-1, len(languages))
    right = np.array([label[i] for i in unseen], int)

    def loss(t: float) -> float:
        return -np.log(np.maximum(chances(logit / np.exp(t))[np.arange(len(right)), right], 1e-12)).sum() if len(right) and len(languages) > 1 else t * t

    low, high = -3.0, 3.0
    for _ in range(40):  # golden section
        a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return pickle.dumps((languages, (w[:-1] * idf[: 1 << BITS, None] * SCALE).astype(np.float32), w[-1], float(np.exp((low + high) / 2))))


def predict(model: tuple, column: pa.Array) -> tuple[list[str], np.ndarray]:
    languages, w, bias, temperature = model
    points, first, letters = characters(column)
    total, n = np.zeros((len(column), len(languages))), np.zeros(len(column))
    for size in (1, 2, 3):
        key, bounds = buckets(points, first, size)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            total[some] += np.add.reduceat(w[key], bounds[some], axis=0, dtype=np.float64)
        n += np.diff(bounds)
    known = (letters > 0) & (len(languages) > 0)
    if not known.any():
        return [UNKNOWN] * len(column), np.zeros(len(column))
    logit = (total / np.maximum(n, 1)[:, None] + bias) / temperature
    p = chances(logit) if len(languages) > 1 else np.ones((len(column), 1))
    best = p.argmax(axis=1)
    return [languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p.max(axis=1), 0.0)


def languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1, calibrated chance of lang_pred), from the whole text alone; one row for each row.

    Learns where lang is not null and crc32(doc_id as text) modulo 4 is not 2, from at most about ``per_language`` texts of each language;
    ``held_out`` are the rows of that remainder (null for a null id, which is not learned from). Texts that are null or have no letter, and
    all texts if nothing can be learned, get ``und`` with score 0.
    """
    rows = texts(docs, doc_id, text, F.col(lang).cast("string").alias("_lang"))
    open_rows = rows.where(remainder("doc_id", 4) != 2).where("_lang is not null")
    frequency = document_frequency(open_rows.select("doc_id", "text"))
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    sample = stratified(open_rows, "_lang", "doc_id", per_language).select("doc_id", "text", "_lang")
    held = docs.sparkSession.sparkContext.broadcast(pickle.loads(learned(sample, lambda batches: train(batches, idf))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = predict(held.value, batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = rows.select("doc_id", "text").mapInArrow(by_slice(work), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
