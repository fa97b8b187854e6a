"""Delta and variable-byte coding of ascending lists, as Columns and, for files, as plain functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.batches import in_parts

LIMIT = 1 << 32


def delta_encode(values: Column) -> Column:
    """The first value and then the gaps, modulo 2^32."""
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice(values.cast("array<long>"), F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(F.zip_with(values.cast("array<long>"), before, lambda x, y: F.pmod(x - y, F.lit(LIMIT))))


def _lists(values: np.ndarray, sizes: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Lists of ``sizes`` values each, null where ``gone``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()), mask=pa.array(gone))


def _sums(column: pa.Array) -> pa.Array:
    flat, gone = column.flatten(), np.asarray(column.is_null())
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    none = np.asarray(flat.is_null())
    x = np.asarray(flat.fill_null(0), np.int64) % LIMIT
    done = np.concatenate([[0], np.cumsum(x)])
    first = np.zeros(len(x), np.int64)
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = starts[sizes > 0]
    first[none] = np.flatnonzero(none)
    values = pa.array((done[1:] - done[np.maximum.accumulate(first)]) % LIMIT, mask=none)
    return _lists(values, sizes, gone)


def delta_decode(gaps: Column) -> Column:
    """Running sums of the gaps, modulo 2^32; a null gap is null and the sum begins anew after it."""

    @F.arrow_udf("array<long>")
    def sums(column: pa.Array) -> pa.Array:
        return in_parts(column, column.value_lengths(), _sums)

    return sums(gaps.cast("array<long>"))


def varbyte_size(value: Column) -> Column:
    """Bytes that a value below 2^32 takes: seven bits each."""
    value = value.cast("long")
    return sum((F.when(value >= (1 << s), 1).otherwise(0) for s in (7, 14, 21, 28)), F.lit(1))


def compressed_size(values: Column) -> Column:
    """Bytes of a list after delta and variable-byte coding."""
    return F.aggregate(delta_encode(values), F.lit(0), lambda n, x: n + varbyte_size(x))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all lists one after another, which of them are null, and how many each list has."""
    flat = column.flatten()
    return np.asarray(flat.fill_null(0), np.int64), np.asarray(flat.is_null()), np.asarray(column.value_lengths().fill_null(0), np.int64)


def _gaps(values: np.ndarray, none: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """delta_encode() of such lists: a value that is null, or has a null before it, gives none."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    before, gone = np.concatenate([[0], values[:-1]])[: len(values)], np.concatenate([[False], none[:-1]])[: len(values)]
    before[first], gone[first] = 0, False
    return (values - before) % LIMIT, none | gone


def _bytes(values: np.ndarray, none: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of such lists: all values get the place of their first byte, and are written byte by byte from there."""
    takes = np.where(none, 0, 1 + sum((values >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28)))
    ends = np.cumsum(takes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left = ends - takes, values
    for i in range(5):
        some = np.flatnonzero(takes > i)
        out[at[some] + i] = left[some] >> 7 * i & 127 | np.where(left[some] >= 1 << 7 * (i + 1), 128, 0)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])


def varbyte_encode(values: Column) -> Column:
    """Bytes of a list: seven bits each, low first, the top bit set while more follow. Nulls take none."""

    @F.arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        return in_parts(column, column.value_lengths(), lambda part: _bytes(*_numbers(part)))

    return encoded(values.cast("array<long>"))


def compress(values: Column) -> Column:
    """varbyte_encode(delta_encode()) in one step."""

    @F.arrow_udf("binary")
    def encoded(column: pa.Array) -> pa.Array:
        def work(part: pa.Array) -> pa.Array:
            numbers, none, sizes = _numbers(part)
            return _bytes(*_gaps(numbers, none, sizes), sizes)

        return in_parts(column, column.value_lengths(), work)

    return encoded(values.cast("array<long>"))


def _values(column: pa.Array) -> pa.Array:
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
    flat = np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint8).astype(np.int64)
    gone = np.asarray(column.is_null()).copy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = (np.cumsum(sizes) - 1)[sizes > 0]
    ends = flat < 128
    gone[owner[last[~ends[last]]]] = True
    ends[last] = True
    at = np.flatnonzero(ends)
    starts = np.concatenate([[0], at[:-1] + 1]) if len(at) else at
    long = at - starts + 1
    gone[owner[at[long > 5]]] = True
    place = np.minimum(np.arange(len(flat)) - np.repeat(starts, long), 5)
    values = np.add.reduceat((flat & 127) << 7 * place, starts) % LIMIT if len(at) else at
    counts = np.bincount(owner[at], minlength=len(sizes))
    return _lists(values, counts, gone)


def varbyte_decode(data: Column) -> Column:
    """The list in a byte string; null where it breaks off inside a value or a value has more than five bytes."""

    @F.arrow_udf("array<long>")
    def lists(column: pa.Array) -> pa.Array:
        return in_parts(column, pa.compute.binary_length(column), _values)

    return lists(data)


def decompress(data: Column) -> Column:
    return delta_decode(varbyte_decode(data))


def pack_numbers(values: list[int]) -> bytes:
    """compress() for one list on the driver or in a worker."""
    out, last = bytearray(), 0
    for v in values:
        gap, last = (v - last) % LIMIT, v
        while gap >= 128:
            out.append(gap & 127 | 128)
            gap >>= 7
        out.append(gap)
    return bytes(out)


def unpack_numbers(data: bytes) -> list[int]:
    """Reverses pack_numbers(); ValueError on bytes that are none of its results."""
    out, total, value, shift = [], 0, 0, 0
    for b in data:
        if shift > 28:
            raise ValueError("a value of more than five bytes")
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            total = (total + value) % LIMIT
            out.append(total)
            value = shift = 0
    if shift:
        raise ValueError("the bytes break off inside a value")
    return out
