"""Columns of texts as flat arrays of bytes, a stretch of rows at a time: what runs over symbols runs over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 20  # bytes of texts together; a longer text is alone


def flat(batch: pa.RecordBatch, column: int, most: int = STRETCH) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batch, each with the bytes of its texts one after the other and where each begins (and the last ends). Nulls count as empty."""
    texts = batch.column(column)
    texts = pc.fill_null(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1, at + 1)
        yield batch.slice(at, end - at), data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def ends_of(bounds: np.ndarray) -> np.ndarray:
    """For each byte, where its text ends."""
    return np.repeat(bounds[1:], np.diff(bounds))


def fixed(words: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of strings or binaries of one width, from a row of bytes for each."""
    n, k = words.shape
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)), pa.py_buffer(np.ascontiguousarray(words).tobytes())])
