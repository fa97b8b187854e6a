"""The positional inverted index as four tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.batches import give_back, text_parts
from lexmill.functions.text import TOKEN, TextOptions, split, tokens
from lexmill.sources.scratch import written


@dataclass
class SearchIndex:
    """``docs (doc_id, path, length)``, ``postings (term, doc_id, tf, positions)``, ``term_stats (term, df, cf)`` and
    ``corpus_stats (n_docs, total_len, avgdl)``, one row. Documents without tokens count in the statistics."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    options: TextOptions = TextOptions()
    _stats: tuple | None = field(default=None, repr=False)

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        if self._stats is None:
            row = self.corpus_stats.first()
            self._stats = (row["n_docs"], row["avgdl"])
        return self._stats

    def df(self, term: str) -> int:
        row = self.term_stats.where(F.col("term") == term).first()
        return row["df"] if row else 0

    def tf(self, term: str, doc_id: int) -> int:
        row = self.postings.where((F.col("term") == term) & (F.col("doc_id") == doc_id)).select("tf").first()
        return row["tf"] if row else 0

    def lookup(self, term: str) -> DataFrame:
        """Postings of a term; the condition reaches the scan of a stored index."""
        return self.postings.where(F.col("term") == term)

    def universe(self) -> DataFrame:
        return self.docs.select("doc_id")


def postings_of(docs: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """``term, doc_id, tf, positions`` from ``doc_id, text``.

    A document's postings are made where its row is: Arrow splits the texts of a part of a batch and numbers their words, and one
    sort by document, word and place brings the positions of each posting together. Nothing is shuffled, and a worker's
    memory follows the bytes of a part, whatever the rows of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, 1):
                words, offsets, names = split(part.column(1), options)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(words)) - np.repeat(offsets[:-1], sizes)
                pair = owner * max(len(names), 1) + words
                order = np.argsort(pair, kind="stable")
                pair, place = pair[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
                ends = np.concatenate([first, [len(pair)]]).astype(np.int32)
                positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
                terms, rows = names.take(pa.array(pair[first] % max(len(names), 1))), pa.array(pair[first] // max(len(names), 1))
                yield pa.RecordBatch.from_arrays([terms, part.column(0).take(rows), pa.array(np.diff(ends)), positions], ["term", "doc_id", "tf", "positions"])
        give_back()

    return docs.mapInArrow(run, "term string, doc_id long, tf int, positions array<int>")


def lengths_of(docs: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """``doc_id, path, length`` from ``doc_id, path, text``."""
    if options == TextOptions():
        length = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0))
    elif not options.stem:
        length = F.size(tokens(F.col("text"), options))
    else:
        # words are stemmed once a part, and none of them leave the worker

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_parts(batch, 2):
                    length = np.diff(split(part.column(2), options)[1])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(length.astype(np.int32))], ["doc_id", "path", "length"])
            give_back()

        return docs.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, path string, length int")
    return docs.select("doc_id", "path", length.alias("length"))


def corpus_of(docs: DataFrame) -> DataFrame:
    """``n_docs, total_len, avgdl``: one row, also without documents."""
    out = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_len"))
    return out.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))


def build_index(docs: DataFrame, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> SearchIndex:
    """An index over any table with an id and a text. Texts that are null are empty."""
    path = F.col(path_col or id_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lengths = lengths_of(rows, options)
    postings = postings_of(rows.select("doc_id", "text"), options)
    # the shuffle carries one row a term and task: counts are combined before it
    term_stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return SearchIndex(lengths, postings, term_stats, corpus_of(lengths), options)


def numbered(docs: DataFrame, order_col: str) -> DataFrame:
    """Dense ids 0, 1, 2 ... in the order of a column.

    The rows are dealt by ranges, sorted and written once; counting a partition and numbering then read the same files, so no
    row can change its partition in between, and no task holds all rows.
    """
    spark: SparkSession = docs.sparkSession
    parts = docs.repartitionByRange(F.col(order_col)).sortWithinPartitions(order_col)
    parts = written(parts.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "numbered")
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, at = {}, 0
    for part in sorted(counts):
        bases[part] = at
        at += counts[part]
    if not bases:
        return docs.withColumn("doc_id", F.lit(0).cast("long"))
    # one number a partition
    table = F.broadcast(spark.createDataFrame(list(bases.items()), "part int, base long"))
    inside = F.col("place").bitwiseAND((1 << 33) - 1)
    return parts.join(table, "part").withColumn("doc_id", F.col("base") + inside).drop("part", "place", "base")


def rank_positions(postings: DataFrame) -> DataFrame:
    """Gaps between the documents of each term, as the compressed format has them."""
    order = Window.partitionBy("term").orderBy("doc_id")
    return postings.withColumn("gap", F.col("doc_id") - F.coalesce(F.lag("doc_id").over(order), F.lit(0)))
