"""The compressed single-file index format, versions 1 and 2, for exchange with other engines.

Layout, little-endian: magic, u32 version, u32 documents, f64 mean length; per document u32 bytes, path, u32 length; u32
terms; per term u32 bytes, term, postings. Version 2 postings: u32 bytes and the packed document ids, u32 lists, and per
list u32 bytes and the packed positions. Version 1 postings: u32 postings, and per posting u32 id, u32 positions, u32 each.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.codecs import pack_numbers, unpack_numbers
from lexmill.functions.text import TextOptions
from lexmill.operators.index import SearchIndex

# Fixed values of the format.
MAGIC = b"MSEI"
NEWEST = 2


class FormatError(ValueError):
    """Bytes that are no index."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("the file breaks off")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def sized(self) -> bytes:
        return self.take(self.u32())


def encode(docs: Iterable[tuple[str, int]], postings: Iterable[tuple[str, list[tuple[int, list[int]]]]], avgdl: float, version: int = NEWEST) -> bytes:
    """Bytes of an index; postings are ``(term, [(doc_id, positions)])`` with ascending ids."""
    put = lambda b: struct.pack("<I", len(b)) + b
    docs, postings = list(docs), list(postings)
    out = [MAGIC, struct.pack("<IId", version, len(docs), avgdl)]
    out += [put(path.encode()) + struct.pack("<I", n) for path, n in docs]
    out.append(struct.pack("<I", len(postings)))
    for term, rows in postings:
        out.append(put(term.encode()))
        if version == 1:
            out.append(struct.pack("<I", len(rows)))
            out += [struct.pack(f"<II{len(p)}I", d, len(p), *p) for d, p in rows]
        else:
            out.append(put(pack_numbers([d for d, _ in rows])) + struct.pack("<I", len(rows)))
            out += [put(pack_numbers(p)) for _, p in rows]
    return b"".join(out)


def decode(data: bytes) -> tuple[list[tuple[str, int]], Iterator[tuple[str, list[tuple[int, list[int]]]]], float]:
    """Documents, postings by term (of a term that comes twice, the first) and mean length; FormatError on other bytes."""
    c = _Cursor(data)
    if c.take(4) != MAGIC:
        raise FormatError("no index")
    version = c.u32()
    if version not in (1, 2):
        raise FormatError(f"version {version}")
    n = c.u32()
    avgdl = struct.unpack("<d", c.take(8))[0]
    text = lambda: c.sized().decode("utf-8", "replace")
    docs = [(text(), c.u32()) for _ in range(n)]
    found: dict[str, list[tuple[int, list[int]]]] = {}
    for _ in range(c.u32()):
        term = text()
        if version == 1:
            rows = []
            for _ in range(c.u32()):
                doc, k = c.u32(), c.u32()
                rows.append((doc, list(struct.unpack(f"<{k}I", c.take(4 * k)))))
        else:
            try:
                ids = unpack_numbers(c.sized())
                if c.u32() != len(ids):
                    raise FormatError("lists and ids differ in number")
                rows = [(d, unpack_numbers(c.sized())) for d in ids]
            except ValueError as error:
                raise FormatError(str(error)) from error
        found.setdefault(term, rows)
    return docs, iter(found.items()), avgdl


def to_bytes(index: SearchIndex, version: int = NEWEST) -> bytes:
    """An index as one value. One file is the format: this is for indexes that fit the driver."""
    docs = [(r["path"], r["length"]) for r in index.docs.orderBy("doc_id").toLocalIterator()]
    dense = index.docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if docs and (dense["a"], dense["b"]) != (0, len(docs) - 1):
        raise ValueError("the format numbers documents from 0 without gaps")
    terms = index.postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "positions"))).alias("rows")).orderBy("term")
    postings = ((r["term"], [(x["doc_id"], x["positions"]) for x in r["rows"]]) for r in terms.toLocalIterator())
    return encode(docs, postings, index.stats()[1], version)


def export(index: SearchIndex, path: str) -> None:
    """Writes an index to one local file, which appears whole or not at all."""
    data = to_bytes(index)
    with open(f"{path}.part", "wb") as file:
        file.write(data)
    os.replace(f"{path}.part", path)


_POSTINGS = "term string, doc_id long, tf int, positions array<int>"


def _rows(content: bytes) -> Iterator:
    import pandas as pd

    for term, found in decode(content)[1]:
        yield pd.DataFrame({"term": term, "doc_id": [d for d, _ in found], "tf": [len(p) for _, p in found], "positions": [p for _, p in found]})


def _index(spark: SparkSession, data: bytes, postings: DataFrame, options: TextOptions) -> SearchIndex:
    docs, _, avgdl = decode(data)
    table = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(docs)], "doc_id long, path string, length int")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    corpus = spark.createDataFrame([(len(docs), sum(n for _, n in docs), avgdl)], "n_docs long, total_len long, avgdl double")
    return SearchIndex(table, postings, terms, corpus, options)


def load(spark: SparkSession, path: str, options: TextOptions = TextOptions()) -> SearchIndex:
    """An index from one file of the format, in any store. The options are not in the file and have to be given again."""
    files = spark.read.format("binaryFile").load(path).select("content")
    row = files.first()
    if row is None:
        raise FormatError(f"empty file: {path}")

    def read(it):
        for rows in it:
            for content in rows["content"]:
                yield from _rows(bytes(content))

    return _index(spark, bytes(row["content"]), files.mapInPandas(read, _POSTINGS), options)


def from_bytes(spark: SparkSession, data: bytes, options: TextOptions = TextOptions()) -> SearchIndex:
    """An index from the bytes of such a file in the driver's memory."""
    rows = [(term, d, len(p), p) for term, found in decode(data)[1] for d, p in found]
    return _index(spark, data, spark.createDataFrame(rows, _POSTINGS), options)
