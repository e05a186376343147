"""Approximate neighbours against brute force: recall, scores, ties, copies, and the order of the priority queue."""

from __future__ import annotations

import math

import numpy as np
import pytest
from test_groups_and_passages import SMALL, rows

from tideblock.llm import ann
from tideblock.llm.frames import table


def expected(vec: list[tuple], every: int, k: int) -> list[tuple]:
    good = [(i, [float(x) for x in v]) for i, v in vec if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        mine = min(v for i, v in good if i == q)
        best = sorted((-(np.array(mine) * np.array(v)).sum(), i) for i, v in good if i != q and len(v) == len(mine))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def awkward() -> list[tuple]:
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 8))
    vec = [(i, (centers[i % 6] * (1 + i % 3) + 0.1 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(200)]
    vec += [(200 + i, vec[0][1]) for i in range(90)] + [(0, vec[0][1]), (0, vec[0][1]), (7, vec[7][1]), (20, vec[3][1]), (20, vec[50][1])] + [(40, vec[40][1])] * 30
    return vec + [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [math.nan] + [0.0] * 7), (303, [math.inf] + [0.0] * 7), (None, vec[1][1]), (310, [1.0, 2.0]), (311, []), (312, [2.0, 1.0]), (320, [0.5, 0.5]), (340, [0.0] * 8), (360, [-0.0] * 8)]


@pytest.mark.parametrize(("part", "leaf", "queries"), [(8192, 64, 512), (20, 4, 3)])
def test_all_answers_at_full_recall(spark, monkeypatch, part, leaf, queries):
    """Ties, repeated rows and ids, copies beyond k, nulls, zeros, non-finite components, other lengths; parts and blocks of a few rows."""
    for name, value in (("PART", part), ("LEAF", leaf), ("QUERIES", queries), ("TARGET", 1.0), ("CALIBRATION", 10**6)):
        monkeypatch.setattr(ann, name, value)
    df = spark.createDataFrame([(*v, 1) for v in awkward()], "vec_id long, embedding array<float>, score int")
    assert rows(ann.nearest(df, "vec_id % 10 = 0")) == expected(awkward(), 10, 20)


def test_recall_and_scores(spark):
    df = table(spark, SMALL, "embeddings")
    vec = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want, got = expected(vec, 20, 20), rows(ann.nearest(df, "vec_id % 20 = 0"))
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    held = dict(vec)
    assert all(math.isclose(s, math.fsum(a * b for a, b in zip(held[q], held[i], strict=True)), rel_tol=1e-12, abs_tol=1e-15) for q, _, i, s in got)
    assert [r[:2] for r in got] == [r[:2] for r in want] and all(a[0] != b[0] or (-a[3], a[2]) < (-b[3], b[2]) for a, b in zip(got, got[1:]))


def test_empty_tables(spark):
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0
    lone = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest(lone, "vec_id % 20 = 0").count() == 0
    assert ann.nearest(lone, "vec_id % 20 = 1").count() == 0


def test_too_long_vectors_raise(spark):
    with pytest.raises(ValueError, match="squared length"):
        ann.nearest(spark.createDataFrame([(20, [1e200])], "vec_id long, embedding array<double>"), "vec_id % 20 = 0")


def test_queue_gives_the_nearest_open_node_first():
    """Leaves come as from a plain search that opens the nearest node of all that are reachable, and every row is in its leaf."""
    r = np.random.default_rng(1)
    x = np.vstack([r.normal(size=(1500, 6)), np.ones((300, 6))])
    tree, place = ann.grow(x, 20)
    counts = np.bincount(place, minlength=tree.leaves)
    assert counts.sum() == 1800 and (np.sort(counts)[:-1] <= 20).all() and counts.max() >= 300 and tree.leaves > 75
    assert (tree.place(x) == place).mean() > 0.99
    far = ann.squares(r.normal(size=(5, 6)), tree.centre)
    for d in far:
        open_nodes, want = {0}, []
        while open_nodes:
            n = min(open_nodes, key=lambda n: (d[n] if n else 0.0, n))
            open_nodes.remove(n)
            if tree.children[n]:
                open_nodes |= set(range(tree.child[n], tree.child[n] + tree.children[n]))
            else:
                want.append(-1 - tree.child[n])
        assert tree.order(d, tree.leaves) == want and tree.order(d, 7) == want[:7]


def test_cheapest_choice():
    late = [(0, 0)] * 90 + [(0, 9)] * 5 + [(3, 1)] * 5
    assert ann.cheapest(late, 90) == (1, 1)
    assert ann.cheapest(late, 95) == (4, 2)
    assert ann.cheapest(late, 100) == (4, 10)
