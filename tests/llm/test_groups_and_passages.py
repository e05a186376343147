"""Near-duplicates and repeated passages against brute force and SQL."""

from __future__ import annotations

import hashlib
from itertools import combinations

import data
import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tideblock.llm import near_dedup, substring_dedup
from tideblock.llm.frames import components, table
from tideblock.llm.words import shingles, slices, words

SMALL = "/root/testdata/sf0.001"


def sql(query: str, folder: str = SMALL) -> list[tuple]:
    c = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return sorted(c.sql(query).fetchall())


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def expected_components(texts: dict, n: int, percent: int) -> dict:
    sets = {i: data.shingles(t, n) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_words_and_shingles_are_those_of_python():
    texts = [r[1] for r in data.awkward()]
    column = pa.array(texts)
    w = words(column)
    assert [[w.text(i) for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [data.words(t) for t in texts]
    keys, first = shingles(w, 4)
    assert np.diff(first).tolist() == [len(data.shingles(t, 4)) for t in texts]
    assert [b - a for a, b in slices(column, 50_000)] and sum(b - a for a, b in slices(column, 50_000)) == len(texts)


def test_neighbouring_texts_do_not_merge_words():
    w = words(pa.array(["ab", "cd", "", None, "ef gh", "i"]))
    assert [w.text(i) for i in range(len(w.start))] == ["ab", "cd", "ef", "gh", "i"]
    assert w.first.tolist() == [0, 1, 2, 2, 2, 4, 5]


def test_near_duplicates_match_sql(spark):
    assert rows(near_dedup.near_duplicates(table(spark, SMALL, "documents"))) == sql(near_dedup.SQL)


def test_near_duplicates_of_awkward_rows(spark):
    docs = data.documents(spark)
    got = rows(near_dedup.near_duplicates(docs))
    known = {r[0]: r[1] for r in data.awkward() if r[0] is not None}
    expected = expected_components(known, 4, 80)
    assert len(got) == docs.count()
    for doc_id, n, component, kept in got:
        if doc_id is None:
            assert component is None and kept
        else:
            assert (n, component) == expected[doc_id] and kept == (doc_id == component)


def test_near_duplicate_chains_are_connected(spark, many_chunks):
    """A drifting chain of 300 texts: neighbours are linked, ends are not; and a cluster of scattered copies around a base."""
    r = np.random.default_rng(3)
    chain, text = [], data.prose(50, 200, 10**6).split(" ")
    for k in range(300):
        text = list(text)
        text[int(r.integers(len(text)))] = f"c{k}"
        chain.append(" ".join(text))
    base = data.prose(60, 150, 10**6)
    texts = chain + [data.edited(base, 70 + k, 0.025) for k in range(200)]
    got = {r[0]: (r[1], r[2]) for r in near_dedup.near_duplicates(data.plain(spark, texts)).collect()}
    assert got == expected_components(dict(enumerate(texts)), 4, 80)


def test_rows_of_one_id_share_a_component(spark):
    a, b = data.prose(1, 50), data.prose(2, 50)
    docs = data.documents(spark, [(5, a, None, None, None, 7, False, 0.5, "c"), (5, b, None, None, None, 7, False, 0.5, "c"), (2, a, None, None, None, 7, False, 0.5, "c"), (9, b, None, None, None, 7, False, 0.5, "c")])
    assert {(r[0], r[2]) for r in near_dedup.near_duplicates(docs).collect()} == {(5, 2), (2, 2), (9, 2)}


def test_one_document_of_each_group_stays_with_its_columns(spark):
    docs = data.documents(spark)
    out = near_dedup.deduplicated(docs, n=5)
    assert out.schema == docs.schema
    known = {r[0]: r[1] for r in data.awkward() if r[0] is not None}
    keep = sorted(i for i, (_, root) in expected_components(known, 5, 80).items() if i == root)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == keep
    assert sum(r.doc_id is None for r in out.collect()) == 1


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(300, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in (7, *range(200, 301))}


def expected_removals(texts: list[tuple], window: int) -> list[tuple]:
    first: dict[tuple, int] = {}
    for i, t in texts:
        w = data.words(t, False)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in texts:
        w = data.words(t, False)
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def test_removals_match_sql(spark):
    assert rows(substring_dedup.removals(table(spark, SMALL, "documents"))) == sql(substring_dedup.SQL)


@pytest.mark.parametrize("window", [13, 3])
def test_removals_of_awkward_rows(spark, window):
    assert rows(substring_dedup.removals(data.documents(spark), window=window)) == expected_removals([r[:2] for r in data.awkward()], window)


def test_passages_of_exactly_a_window_and_hot_passages(spark, monkeypatch):
    """Passages of 12, 13 and 14 words at every place; with a low bound all anchors count as hot and give one phrase to a window."""
    passage = data.prose(9, 14, 10**6).split(" ")
    texts = []
    for k in range(60):
        own = data.prose(100 + k, 30, 10**6).split(" ")
        n = (12, 13, 14)[k % 3]
        texts.append(" ".join(own[:k % 31] + passage[:n] + own[k % 31 :]))
    docs = data.plain(spark, texts)
    expected = expected_removals(list(enumerate(texts)), 13)
    assert rows(substring_dedup.removals(docs)) == expected
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 5)
    assert rows(substring_dedup.removals(docs)) == expected


def test_a_run_many_times_in_two_documents_is_hot(spark, monkeypatch):
    """Log-like texts: an anchor's phrases count, not only its classes, and no key gets more of them than one automaton holds."""
    monkeypatch.setattr(substring_dedup, "HOT", 30)
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 30)
    texts = [" ".join(f"level info took ms {' '.join(str(1000 * d + 13 * k + j) for j in range(n))}" for k in range(300)) for d, n in ((1, 3), (7, 9))]
    texts += [data.prose(1, 40), texts[1][2000:4000]]
    docs = data.plain(spark, texts)
    held = substring_dedup.Found(docs, 13).held
    assert held.where("size(hot) > 0").count() >= 2
    assert substring_dedup.phrases(held, 13).groupBy("shard_key").count().agg({"count": "max"}).first()[0] <= 30
    assert rows(substring_dedup.removals(docs)) == expected_removals(list(enumerate(texts)), 13)


def test_cut_texts_keep_their_columns(spark):
    docs = data.documents(spark)
    out = substring_dedup.deduplicated(docs)
    assert out.schema == docs.schema
    before = {r[:2]: r for r in data.awkward()}
    removed = {(i, n): k for i, n, k, _ in expected_removals([r[:2] for r in data.awkward()], 13)}
    sha = {(r[0], r[3]) for r in expected_removals([r[:2] for r in data.awkward()], 13)}
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        if (r.doc_id, r.text) in before:
            assert removed[(r.doc_id, len(data.words(r.text, False)))] == 0 or r.doc_id is None or r.text == ""
        else:
            assert (r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) in sha and r.n_chars == len(r.text)


def test_empty_tables(spark):
    none = data.documents(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.deduplicated(none).count() == 0
    assert substring_dedup.removals(none).count() == 0
    assert substring_dedup.deduplicated(none).count() == 0


def test_columns_named_like_helpers_stay(spark):
    text = data.prose(2, 80)
    docs = data.plain(spark, [text, text, data.prose(3, 60)]).selectExpr("doc_id", "text", "doc_id as _rows", "'a' as _kept", "'b' as _cuts", "5 as _cut_id", "6 as _ROWS_")
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns and sorted((r.doc_id, r._rows, r._kept) for r in left.collect()) == [(0, 0, "a"), (2, 2, "a")]
    cut = substring_dedup.deduplicated(docs)
    assert cut.columns == docs.columns and sorted((r.doc_id, r.text == "", r._cuts, r._cut_id) for r in cut.collect()) == [(0, False, "b", 5), (1, True, "b", 5), (2, False, "b", 5)]
