"""Ranked lexical search against SQL and a plain version that scores every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pytest
from test_groups_and_passages import SMALL, rows, sql

from tideblock.llm import lexical
from tideblock.llm.frames import table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(data.LOWER))


def expected(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, c.total()) for i, c in own if c]
    n, total = len(own), sum(size for _, _, size in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, size in own:
            m = 25 + 75 * size * n // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_terms_of_odd_texts():
    odd = ["", None, "a-b_c", "Don't STOP 12x3", "\x1c odd\x85 ünï 漢字 \U0001f600 \x1f", "é́x\x7fy\x80z", "[\\]^_`{|}~@:/", "ÄÖ straße"]
    w = lexical.terms(pa.array(odd))
    assert [[w.text(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [terms(t) for t in odd]


def test_search_matches_sql(spark):
    assert rows(lexical.ranked(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))) == sql(lexical.SQL)


@pytest.mark.parametrize(("docs", "block", "window"), [(32_768, 10**6, 1024), (3, 40, 2), (7, 200, 1)])
def test_search_of_awkward_rows(spark, monkeypatch, docs, block, window):
    """Nulls, empty and odd texts, ties, repeated rows and ids; several segments, windows and blocks of items."""
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", docs)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    held = data.awkward() + [(100 + i, data.prose(i % 9, 30), "en", "s", 1, 7, False, 0.5, "c") for i in range(30)]
    items = [(1, "w1 w2, W3 w3 w1"), (2, data.prose(5, 60)), (3, None), (4, ""), (5, "nowhere else"), (None, "one two"), (6, "ünï 漢字"), (6, "w7 w7"), (7, "a"), (8, " ".join(f"w{i}" for i in range(60)))]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert rows(lexical.ranked(data.documents(spark, held), asked)) == expected([r[:2] for r in held], items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked(data.documents(spark), none).count() == 0
    assert lexical.ranked(data.documents(spark, []), some).count() == 0
    assert lexical.ranked(data.documents(spark, [(1, None, None, None, None, 7, False, 0.5, "c")]), some).count() == 0


def test_windows_skip_long_lists():
    """The best of 20,000 documents are those of a full count, while few postings of the long lists are looked at."""
    r = np.random.default_rng(2)
    docs, lists = 20_000, [12_000, 9_000, 15_000, 7_000, 40, 25, 300]
    doc = [np.sort(r.choice(docs, n, replace=False)) for n in lists]
    count = [np.minimum(r.geometric(0.6, n), 6) for n in lists]
    row = {
        "lengths": r.integers(50, 900, docs), "term": np.arange(len(lists), dtype=np.int32), "size": np.array(lists, np.int32),
        "doc": np.concatenate(doc).astype(np.int32), "count": np.concatenate(count).astype(np.int32),
    }
    for window in (64, 1024):
        p = lexical.Postings(row, docs, int(row["lengths"].sum()), window)
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in lists])
        full = np.zeros(docs, np.int64)
        for t, w in enumerate(weights):
            a, b = p.lists[t]
            full[p.doc[a:b]] += w * p.impact[a:b]
        want = np.lexsort((np.arange(docs), -full))[:10]
        found, score = p.best(np.arange(len(lists)), weights, 10, 8)
        assert found.tolist() == want.tolist() and score.tolist() == full[want].tolist()
        assert p.looked < sum(lists) / 4
