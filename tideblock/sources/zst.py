"""Zstandard files of text lines, split by their frames.

A file is a row of bytes (``binaryFile``, so any store that Spark reads will do). Its frames are found from their headers and block sizes,
without decompression, and consecutive frames become parts of a few megabytes, which are read in parallel. A line that runs over the end of a
part belongs to the part it begins in: each part comes with the rest of its last line, and leaves its first line, or piece of one, to the
part before. Decompression streams in steps of fixed size, whatever size a frame's header states.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PART_BYTES = 4 << 20
STEP_BYTES = 1 << 20
# Fixed values of the frame format (RFC 8878).
FRAME, SKIPPABLE, SKIPPABLE_MASK = 0xFD2FB528, 0x184D2A50, 0xFFFFFFF0
DICTIONARY_ID_BYTES, CONTENT_SIZE_BYTES = (0, 1, 2, 4), (0, 2, 4, 8)
RLE_BLOCK, RESERVED_BLOCK = 1, 3
UNREADABLE = "<unreadable frame>"

PARTS = "source_file string, data binary, first boolean, rest binary"
LINES = "source_file string, value string"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends; raises ValueError for what is no whole frame."""
    try:
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & SKIPPABLE_MASK == SKIPPABLE:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif magic == FRAME:
            descriptor = data[at + 4]
            single = descriptor >> 5 & 1
            size = CONTENT_SIZE_BYTES[descriptor >> 6] or single
            end = at + 5 + (1 - single) + DICTIONARY_ID_BYTES[descriptor & 3] + size
            last = False
            while not last:
                head = int.from_bytes(data[end : end + 3], "little")
                if end + 3 > len(data) or head >> 1 & 3 == RESERVED_BLOCK:
                    raise ValueError("broken block")
                last = bool(head & 1)
                end += 3 + (1 if head >> 1 & 3 == RLE_BLOCK else head >> 3)
            end += 4 * (descriptor >> 2 & 1)
        else:
            raise ValueError("no frame")
    except (struct.error, IndexError) as e:
        raise ValueError("cut frame") from e
    if end > len(data):
        raise ValueError("cut frame")
    return end


def parts(data: memoryview, size: int) -> list[memoryview]:
    """Consecutive frames of at least ``size`` bytes together; what follows a broken frame stays with it."""
    out, low, at = [], 0, 0
    while at < len(data):
        try:
            at = frame_end(data, at)
        except ValueError:
            at = len(data)
        if at - low >= size or at == len(data):
            out.append(data[low:at])
            low = at
    return out


def is_whole(data: memoryview) -> bool:
    """Whether a part consists of whole frames."""
    at = 0
    try:
        while at < len(data):
            at = frame_end(data, at)
    except ValueError:
        return False
    return True


def steps(data: memoryview) -> Iterator[bytes]:
    """The decompressed bytes in steps of bounded size; raises zstandard.ZstdError at a broken frame."""
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        while step := reader.read(STEP_BYTES):
            yield step


def first_line(following: list[memoryview]) -> bytes:
    """Text up to the first line end of the parts that follow, its end included; all of it, where they have none."""
    import zstandard

    out = []
    try:
        for part in following:
            for step in steps(part):
                head, end, _ = step.partition(b"\n")
                out += [head, end]
                if end:
                    return b"".join(out)
    except zstandard.ZstdError:
        pass  # the part itself reports it
    return b"".join(out)


def lines(data: memoryview, first: bool, rest: bytes) -> Iterator[list[bytes]]:
    """Lines that begin in a part, some at a time. After a broken frame comes one line that is no JSON."""
    import zstandard

    held, begun, broken = b"", first, not is_whole(data)
    try:
        for step in steps(data):
            if not begun:
                _, end, step = step.partition(b"\n")
                if not end:
                    continue
                begun = True
            *whole, held = (held + step).split(b"\n")
            yield whole
    except zstandard.ZstdError:
        broken = True
    if begun:
        yield (held + rest).split(b"\n")
    if broken:
        yield [UNREADABLE.encode()]


def read_lines(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(source_file, value): the lines of ``binaryFile`` rows, also of a stream of them. Empty lines are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                own = parts(memoryview(content.as_buffer()), part_bytes)
                for i, data in enumerate(own):
                    columns = [pa.array([path.as_py()]), pa.array([data.tobytes()], pa.binary()), pa.array([i == 0]), pa.array([first_line(own[i + 1 :])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["source_file", "data", "first", "rest"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, first, rest in zip(*batch.columns, strict=True):
                for some in lines(memoryview(data.as_buffer()), first.as_py(), rest.as_py()):
                    text = [x.decode("utf-8", "replace") for x in some if x.strip()]
                    if text:
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(text)), pa.array(text)], names=["source_file", "value"])

    cuts = files.select("path", "content").mapInArrow(cut, PARTS)
    spread = cuts if files.isStreaming else cuts.repartition("source_file", "rest", "first")
    return spread.mapInArrow(read, LINES)
