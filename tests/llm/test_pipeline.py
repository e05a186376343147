"""The pipeline against brute force, stage by stage, and the registration of its parts."""

from __future__ import annotations

import corpus_pipeline
import data
import numpy as np
import public_tokenizers
import pyarrow as pa
from test_groups_and_passages import expected_components
from test_search_and_tokens import expected_items
from tokenizers import Tokenizer

from tideblock.llm import packing, quality
from tideblock.llm.queries import QUERIES
from tideblock.scratch import keep

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def cut(texts: dict, window: int = 13) -> dict:
    first: dict = {}
    split = {i: data.words(t, False) for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else texts[i]
    return out


def folder(spark, tmp_path) -> str:
    shared = data.prose(900, 60, 10**6)
    item = data.prose(901, 30, 10**6)
    texts = {i: data.prose(i, 80, 10**6) for i in range(60)}
    texts |= {60 + i: data.edited(texts[i], i, 0.01) for i in range(8)} | {70 + i: data.prose(70 + i, 40, 10**6) + " " + shared for i in range(5)}
    texts |= {80: data.prose(80, 50, 10**6) + " " + item, 81: "", 82: None, 83: "short text"}
    texts |= {100 + i: "!!! ".join(data.prose(100 + i, 60, 10**6).upper().split(" ")) for i in range(30)}
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else "s", None if t is None else len(t)) for i, t in texts.items()]
    marks = [(i, 0 if i >= 100 else 1, 0) for i in texts if i % 2 == 0]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "another item that no document holds at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_each_stage_matches_brute_force(spark, tmp_path):
    path = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_dedup", "substring_dedup", "decontamination", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, path), name)
        assert out.schema == docs.schema
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["quality_classifier"]
    scored = {r.doc_id: r.score for r in quality.scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()}
    assert sorted(after) == sorted(r for r in before if scored[r.doc_id] >= 0.5 or not data.words(r.text))
    assert {r.doc_id for r in after} >= set(range(60)) and not {r.doc_id for r in after} & set(range(100, 130))
    before, after = seen["near_dedup"]
    groups = expected_components({r.doc_id: r.text for r in before}, 5, 80)
    assert sorted(after) == sorted(r for r in before if groups[r.doc_id][1] == r.doc_id) and len(after) < len(before)
    before, after = seen["substring_dedup"]
    cuts = cut({r.doc_id: r.text for r in before})
    assert {r.doc_id: r.text for r in after} == cuts and any(len(cuts[r.doc_id] or "") < len(r.text or "") for r in before)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    dirty = {i for i, *_ in expected_items([(r.doc_id, r.text) for r in before], items)}
    assert dirty == {80} and sorted(after) == sorted(r for r in before if r.doc_id not in dirty)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    whole = {i: b"".join(bytes(r.ids) for r in sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)) for i in {r.doc_id for r in packed}}
    assert whole == {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in after}
    ran = corpus_pipeline.run(spark, path).drop("sequence_id")
    assert sorted(map(str, ran.collect())) == sorted(str(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).drop("sequence_id").collect())


def test_stages_take_awkward_rows_and_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path)
    for rows in (data.awkward(), []):
        docs = data.documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, path))
            assert docs.columns == data.documents(spark, []).columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
        assert (packed.count() > 0) == bool(rows)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert packing.MAX_TOKENS == 4096 and pa.array([1]).type == pa.int64()
