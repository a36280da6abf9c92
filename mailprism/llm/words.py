"""Words of many texts at once, as numbers into a dictionary of their segment.

A segment is a run of rows of one task, of bounded bytes; an index stores one row for each.
Words are runs of digits, letters A-Z (lower-cased) and all that is not ASCII, which is
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text. In UTF-8 these are runs of
bytes, so a whole batch is cut by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from mailprism.llm.common import LOWER, UPPER

# Bytes of text in a segment, unless one text is longer.
SEGMENT_BYTES = 16 << 20

# A byte of a word in lower case; 0 for all other bytes.
_LOWERED = np.zeros(256, np.uint8)
_LOWERED[128:] = np.arange(128, 256)
for _characters in ("0123456789", LOWER):
    _LOWERED[[*_characters.encode()]] = [*_characters.encode()]
_LOWERED[[*UPPER.encode()]] = [*LOWER.encode()]


@dataclass
class Segment:
    """`ids` of the rows; row i has the words codes[bounds[i] : bounds[i + 1]] of `terms`."""

    ids: pa.Array
    bounds: np.ndarray
    codes: np.ndarray
    terms: pa.Array


def _words(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of all texts, and where each text's words begin (and the last one's end)."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _LOWERED[data]
    inside = data != 0
    # A word begins behind another byte or at the start of a text, and ends likewise.
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[cuts] = inside[cuts]
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(data[inside])])
    return words, np.searchsorted(first, offsets)


def words_of(text: str | None) -> list[str]:
    """The words of one text."""
    words, _ = _words(pa.array([text], pa.string()))
    return [w.decode() for w in words.to_pylist()]


def segments(batches: Iterator[pa.RecordBatch], size: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """Rows (id, text) in segments of about `size` bytes of text."""
    held: list[pa.RecordBatch] = []
    count = 0

    def cut() -> Segment:
        ids = pa.concat_arrays([b.column("id") for b in held])
        parts = [_words(b.column("text")) for b in held]
        whole = pa.chunked_array([w for w, _ in parts], pa.binary()).dictionary_encode().combine_chunks()
        bounds, at = [np.zeros(1, np.int64)], 0
        for words, edges in parts:
            bounds.append(edges[1:] + at)
            at += len(words)
        if isinstance(whole, pa.ChunkedArray):
            whole = pa.concat_arrays(whole.chunks)
        codes = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return Segment(ids, np.concatenate(bounds), codes, whole.dictionary)

    for batch in batches:
        if held and count + batch.nbytes > size:
            yield cut()
            held, count = [], 0
        held.append(batch)
        count += batch.nbytes
    if held:
        yield cut()


def packed(values: np.ndarray) -> bytes:
    """Integers of 32 bits as differences, byte by byte, compressed."""
    import zstandard

    steps = np.diff(values.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel(), dtype=np.int32).astype(np.int64)
