"""Merkle manifests against a plain version, SQL, and the definition of a least multiproof."""

from __future__ import annotations

import itertools
import zlib
from hashlib import sha256

import data
import numpy as np
import pytest
from test_groups_and_passages import SMALL, rows, sql

from tideblock.llm import merkle
from tideblock.llm.frames import table


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, more: int = 0) -> str:
    doc_id, text, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, None if n_chars is None else n_chars + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels: list[list[str]], i: int) -> list[tuple[int, str]]:
    return [(i >> k & 1, level[i >> k ^ 1] if i >> k ^ 1 < len(level) else "") for k, level in enumerate(levels[:-1])]


def expected(docs: list[tuple]) -> list[tuple]:
    langs = sorted({r[2] for r in docs}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in docs if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in own[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for x, (i, r) in itertools.chain.from_iterable(((x, e) for e in enumerate(own[x])) for x in langs):
        steps = path(trees[x], i) + path(top, langs.index(x))
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        node = leaf(r, 1) if hit else leaf(r)
        for right, s in steps:
            node = h(s, node) if right else h(node, s)
        out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*[s for _, s in steps]), node, node == top[-1][0]))
    return out


def got(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def ordered(x: list[tuple]) -> list[tuple]:
    return sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_manifest_matches_sql(spark):
    assert rows(merkle.manifest(table(spark, SMALL, "documents"))) == sql(merkle.SQL)


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_manifest_of_awkward_rows(spark, many_chunks, bits):
    """Nulls in each column, empty, long and odd texts, repeated rows and ids, languages of one row, runs of every height."""
    docs = data.awkward()
    docs += [(i, f"t{i}", ["en", "ÿ", "é", "", "z"][i % 5], "s", None if i % 11 == 0 else i % 3 or 2**63 - 1, 7, False, 0.5, "c") for i in range(100, 137)]
    docs += [(500, "alone", "zz", "s", 5, 7, False, 0.5, "c"), (None, None, None, None, None, 7, False, 0.5, "c"), (None, "x", None, "", 0, 7, False, 0.5, "c")]
    found = got(merkle.manifest(data.documents(spark, docs), bits))
    assert ordered(found) == ordered(expected(docs))
    assert 0 < sum(not r[-1] for r in found) < 20


def test_manifest_of_one_row_and_of_none(spark):
    one = [(3, "x", "en", "s", 1, 7, False, 0.5, "c")]
    found = got(merkle.manifest(data.documents(spark, one)))
    assert found == expected(one) and found[0][1] == found[0][2] == found[0][3] and found[0][4] == h()
    assert got(merkle.manifest(data.documents(spark, []))) == []


def test_missing_nodes_are_the_least_that_prove_all_leaves():
    """Every node of a path or its sibling is a leaf asked for, fetched or derived; and no fetched node can be derived from others."""
    r = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 16, 37):
        for _ in range(20):
            asked = np.flatnonzero(r.random(width) < r.choice([0.1, 0.5, 0.9]))
            if not len(asked):
                continue
            fetched, size = set(merkle.missing(asked, width)), width
            known = {(0, int(p)) for p in asked}
            level = 0
            while size > 1:
                for p in {q for k, q in known if k == level}:
                    other = (level, p ^ 1)
                    assert p ^ 1 >= size or (other in fetched) != (other in known)
                    known.add((level + 1, p >> 1))
                size, level = (size + 1) // 2, level + 1
            assert (level, 0) in known and not fetched & known
