"""Token counts under a unigram vocabulary, without building the tokens.

A text is split before each space, as the usual unigram tokenizers do. In a unit, an Aho-Corasick automaton lists all vocabulary pieces
and dynamic programming finds the best sum of scores, carrying only that sum, the number of pieces on its path, and whether the last one
is unknown. Ties go to the earliest start of the last piece; a character without a piece of its own costs the lowest score less 10, and
neighbouring unknowns count once. Units are counted once in a while, all units of a slice together.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tideblock.llm.frames import Cache, texts
from tideblock.llm.words import slices

SPACE = "▁"
UNKNOWN_COST = 10.0
SLICE_BYTES = 4 << 20
LONG = 64
TOGETHER = 1 << 15
_known: dict[str, Cache] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces; the space sign only at their start."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [(p, model.get_score(i)) for i in ids if SPACE not in (p := model.id_to_piece(i))[1:] and " " not in p]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.size = np.array([len(p) for p, _ in pieces], np.int64)
        self.score = np.array([s for _, s in pieces])
        self.unknown = float(self.score.min()) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (p, _) in enumerate(pieces):
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def counts(self, units: list[str]) -> np.ndarray:
        """Pieces of each unit, which has no space."""
        if not units:
            return np.zeros(0, np.int64)
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-length, kind="stable")  # so that units of a length or more come first
        units, length = [units[i] for i in order], length[order]
        out = np.zeros(len(units), np.int64)
        long = int(np.searchsorted(-length, -LONG, side="left"))
        for i in range(long):
            out[order[i]] = self._one(units[i])
        for low in range(long, len(units), TOGETHER):
            out[order[low : low + TOGETHER]] = self._many(units[low : low + TOGETHER], length[low : low + TOGETHER])
        return out

    def _many(self, units: list[str], length: np.ndarray) -> np.ndarray:
        start = np.concatenate([[0], (length + 1).cumsum()[:-1]])
        found = np.fromiter(chain.from_iterable(self.automaton.iter(" ".join(units))), np.int64).reshape(-1, 2)
        unit = np.repeat(np.arange(len(units)), length + 1)[found[:, 0]]
        end, piece = found[:, 0] - start[unit] + 1, found[:, 1]
        most, longest = int(length[0]), int(self.size.max())
        group = end * (longest + 1) + longest - self.size[piece]  # by end, longest first
        group = group.astype(np.int16) if (most + 1) * (longest + 1) < 1 << 15 else group
        by = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[by], np.arange((most + 1) * (longest + 1) + 1))
        unit, piece = unit[by], piece[by]
        best = np.zeros((most + 1, len(units)))
        count = np.zeros((most + 1, len(units)), np.int32)
        unknown = np.zeros((most + 1, len(units)), bool)
        for e in range(1, most + 1):
            n = int(np.searchsorted(-length, -e, side="right"))  # units that are long enough
            top, many, bad = best[e], count[e], unknown[e]
            top[:n] = -np.inf
            for size in range(min(e, longest), 0, -1):
                k = e * (longest + 1) + longest - size
                a, b = bounds[k], bounds[k + 1]
                at = unit[a:b]
                if size == 1:
                    lone = np.ones(n, bool)
                    lone[at] = False
                    lone = np.flatnonzero(lone)
                if a < b:
                    value = best[e - size][at] + self.score[piece[a:b]]
                    better = value > top[at]
                    at = at[better]
                    top[at], many[at], bad[at] = value[better], count[e - size][at] + 1, False
            value = best[e - 1][lone] + self.unknown
            better = value > top[lone]
            at = lone[better]
            top[at], many[at], bad[at] = value[better], count[e - 1][at] + ~unknown[e - 1][at], True
        return count[length, np.arange(len(units))]

    def _one(self, unit: str) -> int:
        ends: list[list[int]] = [[] for _ in range(len(unit) + 1)]
        for end, piece in self.automaton.iter(unit):
            ends[end + 1].append(piece)
        path = [(0.0, 0, False)]
        for e in range(1, len(unit) + 1):
            best, lone = None, True
            for piece in ends[e]:  # longest first
                size = int(self.size[piece])
                lone &= size > 1
                score, n, _ = path[e - size]
                if best is None or score + self.score[piece] > best[0]:
                    best = (score + self.score[piece], n + 1, False)
            if lone:
                score, n, bad = path[e - 1]
                if best is None or score + self.unknown > best[0]:
                    best = (score + self.unknown, n + (not bad), True)
            path.append(best)
        return path[-1][1]


@cache
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def text_counts(column: pa.Array, path: str) -> np.ndarray:
    lists = pc.split_pattern(pc.replace_substring(column.fill_null(""), SPACE, " "), " ")
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    units = coded.dictionary.to_pylist()
    each = np.array(_known.setdefault(path, Cache()).get(units, lambda fresh: _counter(path).counts([SPACE + u for u in fresh]).tolist()), np.int64)
    n = each[coded.indices.to_numpy(zero_copy_only=False)]
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    n[offsets[:-1][np.asarray(pc.equal(flat.take(pa.array(offsets[:-1])), ""))]] = 0  # no unit before a space that begins the text
    total = np.concatenate([[0], n.cumsum()])
    return total[offsets[1:]] - total[offsets[:-1]]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for each row, over the whole text. Nulls and empty texts have no token; ids may repeat or be null."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                n = text_counts(batch.column(1).slice(low, high - low), path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(n)], names=["doc_id", "n_tokens"])

    return texts(docs, doc_id, text).mapInArrow(run, "doc_id long, n_tokens long")
