"""Runs of letters in Arrow string columns, a batch at a time, without a Python object a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; one longer text is a piece of its own.
PIECE = 8 << 20


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PIECE bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right"))
        upto = max(at + 1, upto)
        yield batch.slice(at, upto - at)
        at = upto


def words(texts: pa.Array, spaced: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): the row and the word's place in `words` of each run, in order.

    spaced() takes the bytes of all texts and returns as many, with a space
    for each byte that is in no run.  It must not look across texts.
    """
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    clean = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(at - at[0]), pa.py_buffer(np.ascontiguousarray(spaced(data))))
    split = pc.ascii_split_whitespace(clean)
    row = np.repeat(np.arange(len(raw)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    return row[real.to_numpy(zero_copy_only=False)], coded.indices.to_numpy().astype(np.int64), coded.dictionary


def by_table(kept: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """spaced() for runs of the bytes that `kept` holds; A-Z become a-z, as far as they are kept."""
    table = np.full(256, 32, np.uint8)
    table[list(kept)] = list(kept.lower())
    return lambda data: table[data]


def counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of keys (not negative, small enough that their product fits 63 bits) and how often each occurs."""
    sizes = [int(k.max(initial=0)) + 1 for k in keys]
    one = np.ravel_multi_index(keys, sizes) if len(keys[0]) else np.zeros(0, np.int64)
    found, n = np.unique(one, return_counts=True)
    return list(np.unravel_index(found, sizes)), n
