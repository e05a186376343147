"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are powers of two.

Each piece is a sequence of its own, so no sequence crosses documents and none is padded; sequences of equal length form a bucket. A
document of n tokens gives n // 4096 pieces of 4096 and one for each binary digit of the rest, longest first.

Tokens of a text are those of its white-space separated chunks in turn: no rule of the tokenizer looks across white space (a test
holds this against encoding whole texts). So a chunk is encoded once in a while, not at every occurrence.
"""

from __future__ import annotations

import os
import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideblock.llm.frames import Cache, texts
from tideblock.llm.words import slices

MAX_TOKENS = 4096
END = 2
SLICE_BYTES = 4 << 20
SEPARATOR = "|"
JOINED = 500
_known: dict[str, Cache] = {}


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(path: str, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk. Many are encoded as one text with separators between them, which is faster; those that hold the sign are not."""
    encode = partial(_tokenizer(path).encode_batch_fast, add_special_tokens=False)
    out: list[bytes] = [b""] * len(chunks)
    plain = [i for i, c in enumerate(chunks) if SEPARATOR not in c]
    other = [i for i, c in enumerate(chunks) if SEPARATOR in c]
    for i, e in zip(other, encode([chunks[i] for i in other]), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    mark = encode([SEPARATOR])[0].ids
    groups = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
    for group, e in zip(groups, encode([f" {SEPARATOR} ".join(chunks[i] for i in g) for g in groups]), strict=True):
        ids = np.array(e.ids, "<u4")
        cuts = np.flatnonzero(ids == mark[0])
        if len(mark) != 1 or len(cuts) != len(group) - 1:
            raise ValueError("the separator is not one token of its own in this tokenizer")
        data = ids.tobytes()
        low = 0
        for i, high in zip(group, [*cuts.tolist(), len(ids)], strict=True):
            out[i] = data[4 * low : 4 * high]
            low = high + 1
    return out


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """uint32 ids of all texts, and where each text's begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(column.fill_null(""))
    coded = lists.flatten().dictionary_encode()
    ids = _known.setdefault(path, Cache()).get(coded.dictionary.to_pylist(), partial(_encode, path))
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    start = size.cumsum() - size
    flat = np.frombuffer(b"".join(ids), "<u4")
    index = coded.indices.to_numpy(zero_copy_only=False)
    n = size[index]
    ends = n.cumsum()
    out = flat[np.repeat(start[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
    bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return out, bounds


def piece_lengths(n: int, most: int = MAX_TOKENS) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens; ``most`` is a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, most: int = MAX_TOKENS, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids (binary, little-endian unsigned 32-bit).

    One row for each piece; ``length`` is its bucket, ``offset`` always 0, ``sequence_id`` unique in the result. Every document ends with
    the id ``end``, so nulls and empty texts give one piece of one token. Rows of one id, and null ids, are documents of their own.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column(1), SLICE_BYTES):
                column = batch.column(1).slice(low, high - low)
                flat, bounds = token_ids(column, path)
                rows, starts, lengths, sums, totals, raw = [], [], [], [], [], []
                for d in range(high - low):
                    data = flat[bounds[d] : bounds[d + 1]].tobytes() + end.to_bytes(4, "little")
                    at = 0
                    for n in piece_lengths(len(data) // 4, most):
                        piece = data[4 * at : 4 * (at + n)]
                        rows.append(low + d)
                        starts.append(at)
                        lengths.append(n)
                        sums.append(zlib.crc32(piece))
                        totals.append(len(data) // 4)
                        if ids:
                            raw.append(piece)
                        at += n
                columns = [batch.column(0).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(raw, pa.binary())] * ids], names=names)

    made = texts(docs, doc_id, text).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids)
    return made.select(*names[:5], F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[5:])
