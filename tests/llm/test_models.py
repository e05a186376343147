"""Learned operators: formulas against brute force, held-out accuracy, defined results for awkward rows."""

from __future__ import annotations

import itertools
import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tideblock.llm import language_id, lm_score, quality, recurrent, toxicity, words
from tideblock.llm.frames import Cache, table
from tideblock.llm.ftrl import Learner, chances

FOLDER = "/root/testdata/sf0.01"


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


def labels(spark):
    rows = [(i, 1 if i % 3 else 0, 1 if i % 4 == 0 else 0, "extra") for i in range(20)] + [(None, 1, 1, "x"), (3, None, None, "x"), (999, 1, 0, "x"), (4, 5, 5, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_ftrl_separates_and_l1_makes_zeros():
    zeros = []
    for l1 in (0.0, 20.0):
        r, learner = np.random.default_rng(0), Learner(50, l1=l1)
        for _ in range(2000):
            x = r.normal(size=50)
            learner.learn(np.arange(50), x, int(x[3] - x[7] > 0))
        w = learner.weights()[:-1, 0]
        assert w[3] > 1 and w[7] < -1
        zeros.append((w == 0).sum())
    assert zeros[0] == 0 and zeros[1] > 40
    assert np.allclose(chances(np.array([[0.0, 0.0, 0.0]])), 1 / 3) and chances(np.array([0.0])) == 0.5


def test_quality_of_held_out_rows(spark):
    docs, known = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    out = quality.scores(docs, known).join(known, "doc_id").toPandas()
    assert len(out) == known.count() and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: crc(i) % 3 == 1)).all() and (out.predicted == (out.score >= 0.5)).all()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.97


def test_quality_score_is_a_sum_over_n_grams():
    """The gather over words equals the weights times counted n-grams, text by text."""
    r = np.random.default_rng(1)
    w = r.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = [t[1] for t in data.awkward()]
    got, n = quality.logits(w, pa.array(texts))
    for text, logit, words in zip(texts, got, n, strict=True):
        buckets, _ = quality.features(pa.array([text]))
        count = Counter(buckets.ravel().tolist())
        assert words == len(data.words(text)) and math.isclose(logit, w[-1] + quality.SCALE * sum(w[b] * c for b, c in count.items()) / max(1, 4 * words), rel_tol=1e-4, abs_tol=1e-4)


def test_quality_of_awkward_rows(spark):
    docs = data.documents(spark)
    out = quality.scores(docs, labels(spark)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) if r.doc_id is not None else r.held_out is None for r in out)
    assert {r.score for r in quality.scores(docs, labels(spark).limit(0)).collect()} == {0.5}
    stay = quality.accepted(docs, labels(spark))
    assert stay.schema == docs.schema and {None, ""} <= {r.text for r in stay.collect()}
    assert quality.scores(data.documents(spark, []), labels(spark)).count() == 0


def test_languages_of_held_out_rows(spark):
    docs = table(spark, FOLDER, "documents")
    out = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda i: crc(i) % 4 == 2)).all()
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert abs(held.score.mean() - (held.lang_pred == held.lang).mean()) < 0.05  # calibrated


def test_document_frequency_is_that_of_brute_force(spark):
    docs = data.documents(spark)
    got = language_id.document_frequency(docs.select("doc_id", "text"))
    expected = Counter()
    for _, text, *_ in data.awkward():
        points, first, _ = language_id.characters(pa.array([text]))
        expected.update({b for n in (1, 2, 3) for b in language_id.buckets(points, first, n)[0].tolist()})
    assert got[-1] == docs.count() and {b: int(n) for b, n in enumerate(got[:-1]) if n} == dict(expected)


def test_languages_of_awkward_rows(spark):
    docs = data.documents(spark)
    out = language_id.languages(docs).collect()
    assert len(out) == docs.count() and {r.lang_pred for r in out} <= {"en", "fr", "und"}
    letters = {i: any(c.isalpha() for c in t or "") for i, t, *_ in data.awkward()}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in out)
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in language_id.languages(none).collect()} == {("und", 0.0)}
    assert language_id.languages(data.documents(spark, [])).count() == 0


def test_kernel_is_that_of_all_subsequences():
    def weights(s: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for c in itertools.combinations(range(len(s)), toxicity.ORDER):
            key = "".join(s[i] for i in c)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    def k(s: str, t: str) -> float:
        a, b = weights("^" + s), weights("^" + t)
        return sum(v * b.get(u, 0) for u, v in a.items())

    words, marks = ["idiot", "id-i0ot", "", "a", "aaaaaa", "漢字x", "moronic", "abcdefghijkl"], ["idiot", "aaa", "ca", "moron"]
    expected = [[(k(s, t) / math.sqrt(k(s, s) * k(t, t))) ** toxicity.POWER if k(s, s) else 0 for t in marks] for s in words]
    assert np.allclose(toxicity.kernel(words, marks), expected, atol=1e-5)
    assert "".join(p[: toxicity.LONGEST // 2] for p in toxicity.pieces("abcdefghij" * 20)).startswith("abcdefghij" * 10)


def test_toxicity_of_held_out_rows(spark):
    docs, known = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    out = toxicity.scores(docs, known).join(known, "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: crc(i) % 5 == 0)).all() and (out.predicted == (out.score >= 0.5)).all()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.05


def test_inserted_and_doubled_characters_are_tolerated():
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pandas().merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")
    rows = rows[rows.lang == "en"].groupby("toxic").head(200)
    model = pickle.loads(toxicity.train([pa.RecordBatch.from_pydict({"doc_id": rows.doc_id.to_numpy(), "text": pa.array(rows.text.tolist()), "label": pa.array(rows.toxic.tolist())})]))
    clean = "Anreti the atshin thorestouti heshly nteaha erwhst the."
    texts = [clean, f"{clean} Pathetic thea.", f"{clean} Path-etic thea.", f"{clean} pathetiic thea.", f"{clean} worth_less thea."]
    score = toxicity.score(model, pa.array(texts), Cache())
    assert score[0] < 0.02 and score[1] > 0.3 and (score[2:] > 2 * score[0]).all()


def test_toxicity_of_awkward_rows(spark):
    docs = data.documents(spark)
    out = toxicity.scores(docs, labels(spark)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.scores(docs, labels(spark).limit(0)).collect()} == {0.5}
    assert toxicity.scores(data.documents(spark, []), labels(spark)).count() == 0


def test_words_are_hashed_few_at_a_time_and_alike():
    column = pa.array([t for _, t, *_ in data.awkward()] + [data.prose(k, 3000) for k in range(100)])
    lm_score.tokens(column)
    tracemalloc.start()
    try:
        token, first = lm_score.tokens(column)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    w = words.words(column)
    assert peak < 14 * len(w.raw)  # 10, and 29 with all hashed at once
    ends = np.zeros(len(token), bool)
    ends[first[1:] - 1] = True
    assert (token[ends] == lm_score.END).all() and (token[~ends] == w.hashes()).all()


def test_chances_of_all_words_sum_to_one():
    r = np.random.default_rng(2)
    weights = [r.normal(0, 0.5, s).astype(np.float32) for s in recurrent.shapes(4, 5)]
    for prefix in ([], [3, 19, 0]):
        total = sum(10 ** recurrent.log10_chances(weights, np.array([*prefix, x]), np.array([0, len(prefix) + 1]), 7)[-1] for x in range(20))
        assert math.isclose(total, 1, rel_tol=1e-5)


def test_state_is_carried_over_windows_and_not_over_documents():
    r = np.random.default_rng(3)
    weights = [r.normal(0, 0.5, s).astype(np.float32) for s in recurrent.shapes(4, 5)]
    sizes = [1, 70, 0, 5, 33, 64, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    ids = r.integers(0, 20, first[-1])
    got = recurrent.log10_chances(weights, ids, first, 7, lanes=3, steps=8)
    for a, b in zip(first[:-1], first[1:], strict=True):
        alone = recurrent.log10_chances(weights, ids[a:b], np.array([0, b - a]), 7, lanes=1, steps=1000) if b > a else np.zeros(0)
        assert np.allclose(got[a:b], alone, atol=1e-4)


def test_gradients_lower_the_loss_as_differences_say(monkeypatch):
    """One window: the change of the loss along the step agrees with the gradient found by differences."""
    monkeypatch.setattr(recurrent, "HIDDEN", 4)
    r = np.random.default_rng(4)
    weights = [r.normal(0, 0.5, s).astype(np.float32) for s in recurrent.shapes(3, 2)]
    first, ids = np.array([0, 4, 9]), r.integers(0, 6, 9)

    def loss(w) -> float:
        return -recurrent.log10_chances(w, ids, first, 5).sum() * math.log(10) / 9

    start = [w.copy() for w in weights]
    stepped = [w.copy() for w in weights]
    recurrent.learn(stepped, ids, first, 5, [np.full_like(w, 1e8) for w in weights], rate=1.0, lanes=2, steps=16)
    grads = [(a - b) * 1e4 for a, b in zip(start, stepped, strict=True)]
    for k, g in enumerate(grads):
        for at in itertools.islice(np.ndindex(g.shape), 0, None, max(1, g.size // 5)):
            up, down = [w.copy() for w in start], [w.copy() for w in start]
            up[k][at] += 1e-2
            down[k][at] -= 1e-2
            assert math.isclose((loss(up) - loss(down)) / 2e-2, g[at], rel_tol=0.1, abs_tol=5e-3), (k, at)


def brute_base(texts: list[tuple]) -> dict:
    tokens = [(i, [*data.words(t), None]) for i, t in texts]
    counts = Counter(w for i, ws in tokens if i is not None and crc(i) % 5 != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    chance = {w: math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for _, ws in tokens for w in ws}
    return {(i, len(ws)): (sum(w in counts for w in ws), total, sum(chance[w] for w in ws)) for i, ws in tokens}


@pytest.mark.parametrize("frequent", [1 << 18, 5])
def test_base_scores_of_awkward_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    docs = data.documents(spark)
    out = lm_score.scores(docs).collect()
    expected = brute_base([r[:2] for r in data.awkward()])
    assert len(out) == docs.count()
    for r in out:
        known, total, base = expected[(r.doc_id, r.n_tokens)]
        assert (r.n_known, r.train_tokens) == (known, total) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        assert r.held_out == (crc(r.doc_id) % 5 == 1) if r.doc_id is not None else r.held_out is None
    assert lm_score.scores(data.documents(spark, [])).count() == 0


def test_the_network_beats_the_counts_on_held_out_rows(spark):
    out = lm_score.scores(table(spark, FOLDER, "documents")).toPandas()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_every_training_document_is_learned_and_weights_are_carried(spark, monkeypatch):
    """A pattern outside of the first sample and of any fixed sixteenth, in many small batches of one task."""
    monkeypatch.setattr(lm_score, "WARM_TEXTS", 40)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        turns = "left right up down " * 40
        ids = spark.range(1200).select(
            "id",
            (F.pmod(F.xxhash64("id", F.lit("warm")), F.lit(1_000_003)) / 1_000_003.0).alias("warm"),
            F.pmod(F.xxhash64("id", F.lit("language model")), F.lit(16_000)).alias("place"),
        )
        rows = []
        for i, warm, place in ids.collect():
            seen = warm < 0.06 or place < 1000
            words = turns.split()
            random.Random(i).shuffle(words)
            rows.append((i, " ".join(words) if seen else turns))
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        out = [r for r in lm_score.scores(docs).collect() if r.held_out and rows[r.doc_id][1] == turns]
        gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
        assert len(out) > 100
        assert gain > 0.3, gain  # of 0.6: log10 of four equally frequent words
    finally:
        spark.conf.set(name, before)
