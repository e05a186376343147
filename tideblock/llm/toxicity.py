"""Toxicity by a support vector machine over gap-weighted subsequences, with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters, each weighed by the stretch it takes in both, so gaps and
inserted characters cost a little instead of all. The kernel of two sentences sums a power of the normalised word kernel over their
different words. Landmarks are words and beginnings of words that mark toxic documents, chosen so that together they cover them; a sign before the
first character makes beginnings count. The kernel of a word with them, whitened by the kernel among them, is its Nyström
map. A sentence is the sum of its words' maps, so a linear machine over sentences gives each word a margin, and a whole text costs one
kernel row for each different word.

Labels mark documents, so a toxic document's most toxic sentence stands for it; which one that is and the machine are found in turn.
These sentences are learned a second time with a character put into their most toxic word.
A document's score is that of its most toxic sentence, as a chance.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import Cache, learned, remainder, stratified, texts
from tideblock.llm.words import slices

ORDER = 3
DECAY = 0.8
POWER = 3
LANDMARKS = 28
BEGINNINGS = (4, 5, 6)
COVERED = 0.35
BENT = 0.3
PER_LABEL = 1500
LONGEST = 24
SENTENCE_WORDS = 40
SPELLED = 3
SLICE_BYTES = 4 << 20
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_FIRST = "^"
_known: dict[int, Cache] = {}


def _points(words: list[str], width: int) -> np.ndarray:
    """(words, width) code points, 0 after a word's end."""
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width)


def _common(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row of s (n, length) with each row of t (m, width); or, for t of (n, 1, width), with its own one."""
    t = t[None, :, :] if t.ndim == 2 else t
    columns = [np.ascontiguousarray(t[:, :, j]) for j in range(t.shape[2])]
    shape = np.broadcast_shapes((len(s), 1), columns[0].shape)
    # prefix[q][j]: common subsequences of q + 1 characters so far that end before position j of t, weighed up to here in both.
    prefix = [[np.zeros(shape, np.float32) for _ in columns] for _ in range(ORDER - 1)]
    total = np.zeros(shape, np.float32)
    same, ends = np.empty(shape, np.float32), np.empty(shape, np.float32)
    run = [np.zeros(shape, np.float32) for _ in range(ORDER - 1)]
    for i in range(s.shape[1]):
        x = np.where(s[:, i] == 0, 1, s[:, i])[:, None]  # 1 is in no word
        for r in run:
            r.fill(0)
        for j, column in enumerate(columns):
            np.multiply(x == column, np.float32(DECAY * DECAY), out=same)
            np.multiply(same, prefix[-1][j], out=ends)
            total += ends
            for q in range(ORDER - 2, -1, -1):
                now = same
                if q:
                    now = np.multiply(same, prefix[q - 1][j], out=ends)
                prefix[q][j] *= DECAY
                prefix[q][j] += run[q]
                run[q] += now
                run[q] *= DECAY
    return total


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """(words, landmarks) normalised kernel to the ``POWER``; 0 for words of fewer than two characters."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not landmarks:
        return out
    words, landmarks = [_FIRST + w for w in words], [_FIRST + m for m in landmarks]
    marks = _points(landmarks, max(map(len, landmarks)))
    own = np.diag(_common(marks, marks))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for low in range(0, len(order), 1024):
        rows = order[low : low + 1024]
        s = _points([words[i] for i in rows], max(1, len(words[rows[-1]])))
        self = _common(s, s[:, None, :])[:, 0]
        norm = np.sqrt(self[:, None] * own[None, :])
        out[rows] = np.where(norm > 0, _common(s, marks) / np.maximum(norm, 1e-12), 0) ** POWER
    return out


def pieces(word: str) -> list[str]:
    """Overlapping parts of bounded length, which together hold every stretch of half that length."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def unit(word: str) -> str:
    return word.lower().strip(_EDGE)


class Sentences:
    """Words of texts by sentence: distinct units, for each word its unit, and where sentences and texts begin."""

    def __init__(self, column: pa.Array):
        lists = pc.ascii_split_whitespace(column.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        raw = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        self.units = [unit(w) for w in raw]
        ends = np.array([w[-1:] in ".!?" and w != "" for w in raw], bool)
        single = np.array([len(u) == 1 for u in self.units], bool)
        self.word = index.copy()
        spelled = single[index] if len(index) else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(spelled, prepend=False, append=False))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            for c, d in pairwise([a, *self.text[(self.text > a) & (self.text < b)].tolist(), b]):
                if d - c >= SPELLED:  # a word spelled out
                    self.units.append("".join(self.units[i] for i in index[c:d]))
                    self.word[c] = len(self.units) - 1
        begins = np.zeros(len(index) + 1, bool)
        begins[1:] = ends[index] if len(index) else begins[1:]
        begins[self.text] = True
        first = np.flatnonzero(begins)
        parts = [np.arange(a, b, SENTENCE_WORDS) for a, b in pairwise(first.tolist())]
        self.first = np.concatenate([*parts, [len(index)]]).astype(np.int64)
        # The different words of each sentence: (sentence, unit), in order.
        pair = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * len(self.units) + self.word
        pair.sort()
        pair = pair[np.diff(pair, prepend=-1) > 0]
        self.sentence, self.word = pair // max(1, len(self.units)), pair % max(1, len(self.units))
        self.start = np.searchsorted(self.sentence, np.arange(len(self.first) - 1))


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        inside = y * (x @ w) < 1
        a, c = x[inside], weight[inside]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def _numbered(strings: Iterable[str]) -> tuple[list[str], np.ndarray]:
    """Different strings, and the place of each string among them."""
    seen: dict[str, int] = {}
    index = np.array([seen.setdefault(x, len(seen)) for x in strings], np.int64)
    return list(seen), index


def _landmarks(names: list[str], doc: np.ndarray, word: np.ndarray, label: np.ndarray) -> tuple[list[str], np.ndarray, list[int]]:
    """Candidates (words and beginnings), their log odds of toxic documents, and the chosen ones, each covering documents the others don't."""
    pair = np.unique(doc * len(names) + word)
    doc, word = pair // len(names), pair % len(names)
    parts = [[n[:k] for n in names] for k in BEGINNINGS] + [names]
    candidates, index = _numbered(p for part in parts for p in part)
    index = index.reshape(len(parts), -1)
    pair = np.unique(np.concatenate([doc * len(candidates) + ids[word] for ids in index]))
    doc, unit = pair // len(candidates), pair % len(candidates)
    toxic = np.bincount(unit, weights=label[doc], minlength=len(candidates))
    other = np.bincount(unit, weights=1 - label[doc], minlength=len(candidates))
    ratio = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((other + 0.5) / ((1 - label).sum() + 1))
    usable = np.array([ORDER <= len(c) <= LONGEST for c in candidates]) & (toxic >= 3) & (ratio > 1)
    some = label[doc] == 1
    doc, unit = doc[some], unit[some]
    longer = np.array([1 + 0.02 * len(c) for c in candidates])
    weight, chosen = np.ones(len(label)), []
    for _ in range(LANDMARKS):
        gain = np.where(usable, np.bincount(unit, weights=weight[doc], minlength=len(candidates)) * ratio * longer, 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen.append(best)
        usable[best] = False
        weight[doc[unit == best]] *= COVERED
    return candidates, ratio, chosen


def _bent(word: str, at: int) -> str:
    """The word with a sign inserted, or with a character doubled."""
    k = 1 + at % max(1, len(word) - 1)
    return word[:k] + (word[k - 1] if at % 2 else _EDGE[at % len(_EDGE)]) + word[k:]


def train(batches: list[pa.RecordBatch]) -> bytes:
    """Pickled (landmarks, weight of each landmark's kernel, bias, slope and offset of the chance). Columns: doc_id, text, label."""
    column = pa.concat_arrays([b.column(1) for b in batches]) if batches else pa.array([], pa.string())
    label = np.concatenate([b.column(2).to_numpy() for b in batches]) if batches else np.zeros(0, int)
    if not (0 < label.sum() < len(label)):
        share = (label.sum() + 0.5) / (len(label) + 1)
        return pickle.dumps(([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share)))))
    s = Sentences(column)
    names, unit_id = _numbered(s.units)
    word = unit_id[s.word]
    owner = np.searchsorted(s.text, s.first[:-1], side="right") - 1
    doc = owner[s.sentence]
    candidates, ratio, chosen = _landmarks(names, doc, word, label)
    marks = [candidates[i] for i in chosen]
    if not marks:
        return pickle.dumps(([], np.zeros(0), 0.0, 0.0, 0.0))
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    white = vectors / np.sqrt(np.maximum(values, 1e-3))
    maps = np.concatenate([kernel(names[i : i + 100_000], marks) for i in range(0, len(names), 100_000)])
    rows = s.start
    maps = maps @ white
    summed = np.add.reduceat(maps[word], rows, axis=0) if len(rows) else np.zeros((0, len(marks)))
    strength = {m: ratio[i] for m, i in zip(marks, chosen, strict=True)}
    hint = np.array([max(strength.get(n[:k], 0.0) for k in (*BEGINNINGS, len(n))) for n in names])
    guess = np.add.reduceat(hint[word], rows)
    marked = np.flatnonzero(hint[word] > 0)  # the most toxic word of a sentence, and what a character in it changes
    marked = marked[np.lexsort((-hint[word[marked]], s.sentence[marked]))]
    marked = marked[np.diff(s.sentence[marked], prepend=-1) > 0]
    bent = np.zeros_like(summed)
    bent[s.sentence[marked]] = kernel([_bent(names[word[m]], int(m)) for m in marked], marks) @ white - maps[word[marked]]
    bounds = np.searchsorted(owner, np.arange(len(label) + 1))
    bad = [d for d in np.flatnonzero(label == 1) if bounds[d + 1] > bounds[d]]
    clean = np.flatnonzero(label[owner] == 0)
    w = None
    for _ in range(4):
        stands = np.array([bounds[d] + int(guess[bounds[d] : bounds[d + 1]].argmax()) for d in bad], int)
        x = np.concatenate([summed[stands], summed[stands] + bent[stands], summed[clean]])
        y = np.concatenate([np.ones(2 * len(stands)), -np.ones(len(clean))])
        w = machine(x, y, np.concatenate([np.full(len(stands), 1.0), np.full(len(stands), BENT), np.full(len(clean), len(stands) / max(1, len(clean)))]) / max(1, len(stands)))
        guess = summed @ w[:-1] + w[-1]
    top = np.full(len(label), w[-1])
    top[np.unique(owner)] = np.maximum.reduceat(guess, bounds[:-1][np.diff(bounds) > 0])
    slope, offset = _chance(top, label)
    return pickle.dumps((marks, white @ w[:-1], float(w[-1]), slope, offset))


def _chance(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, with softened targets."""
    a, b = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (a + 1) / (a + 2), 1 / (b + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def score(model: tuple, column: pa.Array, cache: Cache) -> np.ndarray:
    marks, alpha, bias, slope, offset = model
    s = Sentences(column)

    def margins(words: list[str]) -> list[float]:
        parts = [pieces(w) for w in words]
        flat = kernel([p for ps in parts for p in ps], marks) @ alpha
        if len(flat) == len(words):
            return flat.tolist()
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        return np.maximum.reduceat(flat, first).tolist()

    top = np.full(len(column), bias)
    if len(s.start) and marks:
        names = dict.fromkeys(s.units)
        value = dict(zip(names, cache.get(list(names), margins), strict=True))
        each = np.fromiter((value[u] for u in s.units), np.float64, len(s.units))
        margin = np.add.reduceat(each[s.word], s.start) + bias
        bounds = np.searchsorted(s.first[:-1], s.text)
        some = np.flatnonzero(np.diff(bounds))
        top[some] = np.maximum.reduceat(margin, bounds[some])
    return 1 / (1 + np.exp(-np.clip(slope * top + offset, -30, 30)))


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted; one row for each row of ``docs``, from the whole text alone.

    Learns where crc32(doc_id as text) modulo 5 is not 0, from at most about ``per_label`` texts of each label, chosen by a hash of the id;
    ``held_out`` are the others (null for a null id). Null and empty texts get the score of an empty sentence. Without labels of both
    kinds, all texts get the share of label 1 (0.5 without any). Labels other than 0 and 1 are not used.
    """
    docs = texts(docs, doc_id, text)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)").where(remainder("doc_id", 5) != 0)
    sample = docs.join(F.broadcast(stratified(known, "_y", "doc_id", per_label)), "doc_id").select("doc_id", "text", "_y")
    held = docs.sparkSession.sparkContext.broadcast((model := learned(sample, train), hash(model)))

    def run(batches):
        data, key = held.value
        model, cache = pickle.loads(data), _known.setdefault(key, Cache())
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(score(model, batch.column(1).slice(low, high - low), cache))], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
