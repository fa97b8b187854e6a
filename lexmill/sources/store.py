"""Indexes as folders of Parquet tables.

A stored index is a list of parts, each a folder with the four tables of some documents, and manifests. A manifest names
the parts that make the index; the one with the highest number counts. Parts are written whole before a manifest names
them and never change, so whoever reads sees one version or the next, and a write that fails leaves the index as it was. The
statistics of an index are sums over its parts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import TextOptions
from lexmill.operators.index import SearchIndex, corpus_of
from lexmill.sources.scratch import Folder

VERSION = 2
TABLES = ("docs", "postings", "term_stats", "corpus_stats")


class IndexError_(RuntimeError):
    """No readable index at a path."""


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    folder = Folder(spark, f"{path}/manifests")
    numbers = [int(n.removesuffix(".json")) for n in folder.names() if n.endswith(".json") and not n.startswith(".")]
    return (max(numbers), json.loads(folder.read(f"{max(numbers):09d}.json"))) if numbers else None


def _commit(spark: SparkSession, path: str, number: int, parts: list[str], options: TextOptions, batches: dict) -> None:
    body = json.dumps({"format_version": VERSION, "tokenizer": asdict(options), "parts": parts, "batches": batches})
    Folder(spark, f"{path}/manifests").put(f"{number:09d}.json", body)


def _write_part(index: SearchIndex, path: str) -> str:
    """The four tables of an index under a new name. Postings and term statistics are dealt by ranges of terms and sorted,
    so a lookup reads the row groups that hold its term; ranges also spread frequent terms over their documents. The
    statistics are counted in what was written."""
    spark, part = index.docs.sparkSession, uuid.uuid4().hex
    at = f"{path}/parts/{part}"
    index.docs.write.parquet(f"{at}/docs")
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
    terms = spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/term_stats")
    corpus_of(spark.read.parquet(f"{at}/docs")).write.parquet(f"{at}/corpus_stats")
    return part


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is an index, readable or not; failures to find out are raised."""
    return Folder(spark, f"{path}/manifests").exists()


def save_index(index: SearchIndex, path: str) -> None:
    """Stores an index; one that is there already stays until the new one is whole, and its parts stay for who reads them."""
    spark = index.docs.sparkSession
    part, held = _write_part(index, path), _manifest(spark, path)
    _commit(spark, path, held[0] + 1 if held else 0, [part], index.options, {})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    try:
        found = _manifest(spark, path)
        if found is None:
            raise FileNotFoundError(path)
        meta = found[1]
        if meta.get("format_version") != VERSION:
            raise ValueError(f"unknown version of an index: {meta.get('format_version')}")
        frames = {t: [spark.read.parquet(f"{path}/parts/{p}/{t}") for p in meta["parts"]] for t in TABLES}
    except Exception as error:
        raise IndexError_(f"Failed to load index: {path}") from error
    docs, postings, terms, corpus = (_union(frames[t]) for t in TABLES)
    if len(meta["parts"]) > 1:
        terms = terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        corpus = corpus.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        corpus = corpus.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))
    return SearchIndex(docs, postings, terms, corpus, TextOptions(**meta["tokenizer"]))


def append(index: SearchIndex, path: str, batch: tuple[str, int] | None = None) -> None:
    """Adds the documents of another index, whose ids must be new, to a stored one. ``batch``, a stream's name and the number
    of its batch, is kept with the part."""
    spark = index.docs.sparkSession
    number, meta = _manifest(spark, path) or (-1, None)
    if meta and TextOptions(**meta["tokenizer"]) != index.options:
        raise ValueError("the indexes differ in their tokens")
    part = _write_part(index, path)
    batches = (meta or {}).get("batches", {}) | ({batch[0]: batch[1]} if batch else {})
    _commit(spark, path, number + 1, [*(meta or {}).get("parts", []), part], index.options, batches)


def last_batch(spark: SparkSession, path: str, stream: str) -> int:
    """The number of the last batch of a stream that the index holds; -1 for none."""
    found = _manifest(spark, path)
    return found[1].get("batches", {}).get(stream, -1) if found else -1


def compact(spark: SparkSession, path: str) -> None:
    """Many parts in one."""
    save_index(load_index(spark, path), path)
