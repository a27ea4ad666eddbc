"""Texts of a batch as one array of bytes, which whole-array steps work on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, one after the other, and where each begins, with the end as one more. Nulls count as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def unflat(data: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The texts that such arrays hold; those that aren't valid are null."""
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    buffers = [mask, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(ends) - 1, buffers).cast(pa.string())


def runs_of(sizes: np.ndarray) -> np.ndarray:
    """Where runs of these sizes begin, and their end as one more."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def begins_character(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80
