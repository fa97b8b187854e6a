"""Helpers shared by the corpus operators: tables, cuts in the shared folder, word hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.batches import by_bytes, give_back  # noqa: F401
from lexmill.sources.scratch import fresh_path

#: What separates words, in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch; with whole texts of some kilobytes this is a few megabytes.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS):
    """Bounds the rows of the Arrow batches that Python workers hold while the block runs; a smaller bound set by the user stays.

    Work that is to have the bound has to run inside the block: cut() it there.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    if not 0 < int(held) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()  # references that Python holds to what was written keep its shuffle files
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Removes the files of tables made by cut() that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def fresh_names(docs: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for columns of an operator's own that no column of ``docs`` has."""
    held = {c.lower() for c in docs.columns}
    out = {}
    for name in wanted:
        own = f"own_{name}"
        while own in held:
            own += "_"
        out[name] = own
    return out


#: Rows of a few numbers each up to which a side of a semi or anti join is broadcast; its size is counted, not assumed.
FEW_ROWS = 2_000_000


def matched(rows: DataFrame, few: DataFrame, on, how: str, limit: int = FEW_ROWS) -> DataFrame:
    """``rows`` semi- or anti-joined (or joined) with a table of keys. As long as the keys are few, the rows stay where they lie."""
    return rows.join(F.broadcast(few) if few.limit(limit + 1).count() <= limit else few, on, how)


def sample_of(rows: DataFrame, key: str, size: int, salt: int) -> DataFrame:
    """About ``size`` rows, at most that many, by a hash of ``key``; the same rows whatever the partitions.

    A threshold on the hash, from the number of rows, does the choosing, so that no task sends more than its share
    to where the few are put in order.
    """
    total = rows.count()
    order = F.xxhash64(F.col(key).cast("string"), F.lit(salt))
    some = rows.withColumn("sample_order", order)
    if total > size:
        some = some.where(F.col("sample_order") < int(-(2**63) + 2**64 * (size / total)))
    return some.orderBy("sample_order", key).limit(size).drop("sample_order")


def doc_crc(id_col: str = "doc_id"):
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


# Hashing of words and shingles over whole Arrow batches, without a Python loop over words.

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = (np.random.default_rng(20240501).integers(1, 2**63, 256).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of an Arrow string array, in order, and the row each word is in.

    A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and return. The hash of a
    word is a difference of prefix sums of byte codes times powers of a base, moved to power zero.
    """
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = (data != 32) & ((data < 9) | (data > 13))
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[edges] = solid[edges]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = solid[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    powers = _powers(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers, out=sums[1:])
    hashes = mix((sums[e] - sums[s]) * _powers(_INV, len(data))[s] ^ (e - s).astype(np.uint64))
    return hashes, np.searchsorted(offsets, s, side="right") - 1


def shingles(column, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the row of each; a row of 1 to k-1 words has one shingle of all its words."""
    words, rows = word_hashes(column)
    n = len(words)
    if not n:
        return words, rows
    counts = np.bincount(rows, minlength=len(column))
    out = np.zeros(n, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    left = counts[rows] - (np.arange(n) - first[rows])
    for j in range(k):
        have = np.flatnonzero(left > j)
        out[have] = mix(out[have] * np.uint64(0xD6E8FEB86659FD93) + words[have + j] + np.uint64(j + 1))
    keep = (left >= k) | ((counts[rows] < k) & (left == counts[rows]))
    return out[keep], rows[keep]
