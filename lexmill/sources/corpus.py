"""Directories of text files as a table of documents, and synthetic corpora."""

from __future__ import annotations

import os
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".md")
#: The words of the synthetic corpus.
VOCABULARY = "river stone lamp window paper garden copper signal harbor meadow winter engine ladder cotton mirror thread orchard compass kettle bridge sparrow marble lantern velvet anchor pepper".split()


def list_files(folder: str) -> list[str]:
    """Paths of all text files under a local folder, component by component in order. A missing folder has none.

    Empty files and names that begin with a dot or an underscore count; links to folders are not followed.
    """
    if os.path.isfile(folder):
        raise NotADirectoryError(folder)
    found = [PurePath(top, name) for top, _, names in os.walk(folder, followlinks=False) for name in names]
    found = [p for p in found if p.suffix in SUFFIXES and os.path.isfile(p)]
    return [str(p) for p in sorted(found, key=lambda p: [x.encode("utf-8", "surrogateescape") for x in p.parts])]


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, path, text``; the executors read the files. A file that cannot be opened takes no id.

    Local paths must be visible to all executors, as any local path of a cluster's job. Paths with another scheme go
    through Spark's reader of binary files, ordered by their path's components; that reader leaves out
    empty and hidden files.
    """
    scheme = folder.split("://")[0] if "://" in folder else "file"
    if scheme != "file":
        from lexmill.operators.index import numbered

        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        files = files.where(F.col("path").rlike(r"/[^/]+\.(txt|md)$")).select("path", F.col("content").cast("string").alias("text"), F.split("path", "/").alias("parts"))
        return numbered(files, "parts").select("doc_id", "path", "text")
    paths = [p for p in list_files(folder.removeprefix("file://")) if os.access(p, os.R_OK)]
    table = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(paths)), "path": paths}), "doc_id long, path string") if paths else spark.createDataFrame([], "doc_id long, path string")

    def read(it):
        for rows in it:
            texts = []
            for path in rows["path"]:
                with open(path, "rb") as file:
                    texts.append(file.read().decode("utf-8", "replace"))
            yield rows.assign(text=texts)

    return table.mapInPandas(read, "doc_id long, path string, text string")


def synthetic(spark: SparkSession, n: int, seed: int = 42, least: int = 20, most: int = 80, vocabulary: list[str] = VOCABULARY) -> DataFrame:
    """``doc_id, path, text``: documents of random length and words, the same for a seed whatever the partitions."""
    words = F.array(*map(F.lit, vocabulary))
    pick = lambda *parts: F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(2**31))
    length = (F.lit(least) + pick(F.col("id"), F.lit(-1)) % (most - least + 1)).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.element_at(words, (pick(F.col("id"), i) % len(vocabulary) + 1).cast("int"))), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("doc_%05d.txt", "id").alias("path"), text.alias("text"))


def write_synthetic(spark: SparkSession, folder: str, n: int, seed: int = 42) -> None:
    """The synthetic corpus as files in a folder that the executors can write to."""
    os.makedirs(folder, exist_ok=True)

    def put(rows) -> None:
        for r in rows:
            with open(os.path.join(folder, r["path"]), "w", encoding="utf-8") as file:
                file.write(r["text"])

    synthetic(spark, n, seed).foreachPartition(put)
