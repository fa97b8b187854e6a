"""Bounds on what Python workers hold of an Arrow batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_bytes(sizes: Iterable[int], most: int = 64 << 20) -> Iterator[tuple[int, int]]:
    """Where a batch is cut so that no part but of one value has more than ``most`` bytes; nothing for no values."""
    a = b = total = 0
    for size in sizes:
        if b > a and total + size > most:
            yield a, b
            a, total = b, 0
        b, total = b + 1, total + size
    if b > a:
        yield a, b


def give_back() -> None:
    """Returns freed memory to the system: idle Python workers would keep it until their next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: Bytes of texts, and values of lists, that are worked on at once; the arrays made of them take some tens of times as much.
TEXT_BYTES, VALUES = 2 << 20, 1 << 18


def text_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """All rows of a batch, in parts of about ``TEXT_BYTES`` bytes of texts in a column; a longer text is a part of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for a, b in by_bytes(sizes, TEXT_BYTES):
        yield batch.slice(a, b - a)


def in_parts(column: pa.Array, sizes: pa.Array, work: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``work`` on all of a column, parts of about ``VALUES`` values at a time, each value counted by ``sizes``."""
    if len(column) == 0:
        return work(column)
    ends = np.asarray(sizes.fill_null(0), np.int64)
    return pa.concat_arrays([work(column.slice(a, b - a)) for a, b in by_bytes(ends.tolist(), VALUES)])
