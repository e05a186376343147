"""Containment, top-k search, packing and token counts against brute force, SQL and the tokenizers themselves."""

from __future__ import annotations

import math
import random
import zlib

import data
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_groups_and_passages import SMALL, rows, sql
from tokenizers import Tokenizer, models, pre_tokenizers

from tideblock.llm import decontaminate, packing, token_counts, top_k
from tideblock.llm.frames import Cache, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "a", " x  y ", "ﬁ Σ ΑΣ İi é ́x don't I'll 12a ''s", "<|endoftext|> a<|startoftext|>b", "a b c　d \x85 \x1c e", "▁x ▁▁ y▁", "日本語 テスト 🎉🎉🎉", "tab\tnew\nline\r\n x", "漢" * 200 + " ௿௿", "| a|b || |", "  \n "]


def expected_items(docs: list[tuple], items: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    out = []
    for i, t in docs:
        own = data.shingles(t, n)
        for j, u in items:
            want = data.shingles(u, n)
            both = len(own & want)
            if want and 100 * both >= percent * len(want):
                out.append((i, j, both, len(want)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def test_containment_matches_sql(spark):
    assert rows(decontaminate.contained(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))) == sql(decontaminate.SQL)


def items() -> list[tuple]:
    base = data.prose(1, 120)
    w = base.split(" ")
    return [(k, " ".join(w[k : k + n])) for k, n in ((0, 5), (3, 6), (20, 14), (30, 24), (40, 60), (0, 120), (90, 9))] + [
        (100, None), (101, ""), (102, "one"), (103, "two words"), (104, "a a a a a a a"), (None, " ".join(w[5:30])), (105, data.edited(" ".join(w[10:70]), 8, 0.03)),
        (106, data.prose(77, 40)), (106, " ".join(w[60:100])), (107, data.prose(3, 3000)[:9000]),
    ]


def test_containment_of_awkward_rows(spark):
    docs, asked = data.documents(spark), spark.createDataFrame([(*i, "x") for i in items()], "item_id long, text string, doc_id string")
    got = [r[:4] for r in rows(decontaminate.contained(docs, asked))]
    assert got == expected_items([r[:2] for r in data.awkward()], items())
    assert len(got) > 20


def test_containment_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    asked = spark.createDataFrame(items(), "item_id long, text string")
    got = [r[:4] for r in rows(decontaminate.contained(data.documents(spark), asked))]
    assert got == expected_items([r[:2] for r in data.awkward()], items())
    clean = decontaminate.clean(data.documents(spark), asked)
    held = {(r[1]) for r in data.awkward() if expected_items([r[:2]], items())}
    assert sorted(map(str, (r.text for r in clean.collect()))) == sorted(str(r[1]) for r in data.awkward() if r[1] not in held)


def test_items_at_every_place_of_long_documents():
    """All passages of 400 are found, with up to a fifth of their shingles gone, inside documents of 30,000 words."""
    r = random.Random(4)
    wanted = [(k, data.prose(1000 + k, r.choice([10, 14, 20, 30, 40, 66, 130]), 10**6)) for k in range(400)]
    index = decontaminate.Index(wanted, 5)
    texts = []
    for k in range(8):
        parts = [data.prose(3000 + 50 * k + j, 600, 10**6) + " " + (wanted[50 * k + j][1] if j % 2 else data.edited(wanted[50 * k + j][1], j, 0.015)) for j in range(50)]
        texts.append(" ".join(parts))
    found = sorted((d, i) for d, i, _, _ in decontaminate.matches(index, pa.array(texts), 5, 80))
    assert found == sorted((i, j) for i, j, _, _ in expected_items(list(enumerate(texts)), wanted))


def test_short_items_inside_long_documents():
    """All of 3,000 items of 5 to 20 words are found in documents of some 25,000 words, also with shingles gone or common to many items."""
    r = random.Random(6)
    wanted = [(k, ("what is the answer to " if k % 3 == 0 and k % 16 > 4 else "") + data.prose(9000 + k, 5 + k % 16, 10**6)) for k in range(3000)]
    index = decontaminate.Index(wanted, 5)
    texts = []
    for k in range(30):
        own = [w if j % 3 else data.edited(w, j, 0.02) for j, (_, w) in enumerate(wanted[100 * k : 100 * k + 100])]
        texts.append(" ".join(data.prose(50_000 + 100 * k + j, r.randrange(200, 300), 10**6) + " " + w for j, w in enumerate(own)))
    found = sorted((d, i) for d, i, _, _ in decontaminate.matches(index, pa.array(texts), 5, 80))
    assert found == sorted((i, j) for i, j, _, _ in expected_items(list(enumerate(texts)), wanted))
    assert len(found) > 2500


def test_containment_of_empty_tables(spark):
    none, asked = data.documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(none, asked).count() == 0
    assert decontaminate.contained(data.documents(spark), asked).count() == 0
    assert decontaminate.clean(data.documents(spark), asked).count() == len(data.awkward())


def test_top_k_matches_sql(spark):
    assert rows(top_k.top_k(table(spark, SMALL, "embeddings"), "vec_id % 50 = 0")) == sql(top_k.SQL)


@pytest.mark.parametrize("queries", [2048, 3])
def test_top_k_of_awkward_vectors(spark, monkeypatch, queries):
    """Ties, repeated rows and ids, nulls, non-finite components, other lengths; pages and regions of a few rows."""
    monkeypatch.setattr(top_k, "PAGE", 4)
    monkeypatch.setattr(top_k, "REGION_ROWS", 50)
    monkeypatch.setattr(top_k, "QUERIES", queries)
    monkeypatch.setattr(top_k, "SAMPLE", 20)
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 8))
    vec = [(i, (centers[i % 6] + 0.1 * r.normal(size=8)).astype(np.float32).tolist(), 1) for i in range(200)]
    vec += [(200 + i, vec[0][1], 1) for i in range(30)] + [(0, vec[0][1], 1), (7, vec[7][1], 2)]
    vec += [(300, None, 1), (301, [1.0, None] + [0.0] * 6, 1), (302, [math.nan] + [0.0] * 7, 1), (303, [math.inf] + [0.0] * 7, 1), (None, vec[1][1], 1), (310, [1.0, 2.0], 1), (311, [], 1), (320, [0.5, 0.5], 1), (350, [0.0] * 8, 1)]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>, score int")
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in vec if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q in sorted({i for i, _ in good if i % 10 == 0}):
        mine = min(v for i, v in good if i == q)
        best = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in good if i != q and len(v) == len(mine))[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert rows(top_k.top_k(df, "vec_id % 10 = 0")) == expected


def test_top_k_prunes_clustered_vectors():
    """Far clusters are ruled out by stored distances: most pages are never opened."""
    r = np.random.default_rng(6)
    vec = (1000 * np.eye(16)[np.arange(1600) % 16] + 5 * r.normal(size=(1600, 16))).astype(np.int64)
    most = float((vec**2).sum(axis=1).max())
    roots = top_k.routing(vec[:200], most)
    block = top_k.Block(np.arange(3), vec[:3], roots, most, 5, np.arange(200), vec[:200])
    reach = [block.reach(q, int(block.floor[q])) for q in range(3)]
    assert (block.to_root <= np.array(reach)[:, None]).mean() < 0.5


def test_top_k_of_an_empty_table(spark):
    assert top_k.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").count() == 0


def test_tokens_by_chunk_are_the_tokenizer_s():
    texts = ODD + [r[1] for r in data.awkward()] + table_texts()
    flat, bounds = packing.token_ids(pa.array(texts), WORD_BPE)
    t = Tokenizer.from_file(WORD_BPE)
    assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def table_texts() -> list[str]:
    import pyarrow.parquet as pq

    return pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()


def test_pieces_are_powers_of_two():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(4096) == [4096]
    for n in (1, 5, 4095, 4097, 10000):
        got = packing.piece_lengths(n)
        assert sum(got) == n and all(x & (x - 1) == 0 for x in got) and got == sorted(got, reverse=True) and len(set(x for x in got if x < 4096)) == sum(x < 4096 for x in got)


def test_packing_round_trip(spark):
    docs = data.documents(spark)
    t = Tokenizer.from_file(WORD_BPE)
    got = packing.pieces(docs).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 4096 for r in got)
    whole: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        if r.start == 0:
            whole.setdefault(r.doc_id, []).append([b"", r.doc_tokens])
        part = whole[r.doc_id][-1]
        assert len(part[0]) == 4 * r.start
        part[0] += bytes(r.ids)
    texts: dict = {}
    for i, x, *_ in data.awkward():
        texts.setdefault(i, []).append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert {i: sorted(p[0] for p in parts) for i, parts in whole.items()} == {i: sorted(x) for i, x in texts.items()}
    assert all(len(p[0]) == 4 * p[1] for parts in whole.values() for p in parts)


def unigram() -> Tokenizer:
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *token_counts.vocabulary(PIECES)], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_token_counts_are_the_tokenizer_s():
    r = random.Random(2)
    texts = ODD + [x[1] for x in data.awkward()] + table_texts()[:60] + ["".join(r.choice("abcdefghij ▁éñ漢௿") for _ in range(r.randint(0, 300))) for _ in range(300)]
    t = unigram()
    assert token_counts.text_counts(pa.array(texts), PIECES).tolist() == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_ties_and_unknowns_of_a_small_vocabulary():
    vocabulary = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("bc", -1.5), ("abc", -3.0), ("▁ab", -3.0)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(3)
    units = ["".join(r.choice("abcxy") for _ in range(r.randint(0, 90))) for _ in range(400)]
    got = token_counts.Counter(vocabulary).counts(["▁" + u for u in units])
    assert got.tolist() == [len(t.encode(u, add_special_tokens=False).ids) if u else 1 for u in units]


def test_token_counts_of_rows(spark):
    t = unigram()
    got = rows(token_counts.token_counts(data.documents(spark)))
    assert got == sorted(((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in data.awkward()), key=lambda r: tuple((x is None, x) for x in r))
    assert token_counts.token_counts(data.documents(spark, [])).count() == 0
    assert packing.pieces(data.documents(spark, [])).count() == 0


def test_caches_are_bounded_by_bytes():
    held = Cache(limit=50_000)
    for k in range(200):
        keys = [f"{k} {i}" for i in range(20)] + ["often"]
        assert held.get(keys, lambda fresh: [f.encode() * 5 for f in fresh]) == [key.encode() * 5 for key in keys]
        for half, size in ((held.young, held.young_bytes), (held.old, held.old_bytes)):
            assert sum(held._size(*pair) for pair in half.items()) == size <= held.limit
    assert "often" in held.old


def test_pieces_of_text_without_spaces_are_not_held():
    """20,000 texts of one piece each, with the ids and counts of the tokenizer."""
    r = random.Random(8)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(100)) for _ in range(20_000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    flat, bounds = packing.token_ids(pa.array(texts), path)
    assert max(map(len, packing._known[path].young), default=0) <= Cache.LONGEST_KEY
    for i in range(0, len(texts), 2000):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == Tokenizer.from_file(path).encode(texts[i], add_special_tokens=False).ids
    path = public_tokenizers.path("piece_bpe_32k.model")
    few = texts[:200]
    one = [int(token_counts.text_counts(pa.array([t]), path)[0]) for t in few]
    assert token_counts.text_counts(pa.array(few), path).tolist() == one
    assert max(map(len, token_counts._known[path].young), default=0) <= Cache.LONGEST_KEY
