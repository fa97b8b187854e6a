"""A stored index kept up to date by a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.text import TextOptions
from lexmill.operators.index import build_index
from lexmill.sources import store


def add_batch(batch: DataFrame, number: int, path: str, stream: str, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Adds one batch to the index under ``path``, or makes the index.

    The documents and the number of the batch appear by one manifest: a batch that stopped before runs again as a
    whole, one that is in does nothing. Documents that the index has are left out; of rows that repeat an id within a
    batch the one with the least text counts. An index that is there but cannot be read fails the batch and stays as it is.
    """
    spark = batch.sparkSession
    rows = batch.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    if store.exists(spark, path):
        held = store.load_index(spark, path)
        if store.last_batch(spark, path, stream) >= number:
            return
        rows = rows.join(held.docs.select(F.col("doc_id").alias("held")), F.col("doc_id") == F.col("held"), "left_anti")
    store.append(build_index(rows, options), path, (stream, number))


def index_stream(docs: DataFrame, path: str, checkpoint: str, options: TextOptions = TextOptions(), id_col: str = "doc_id", text_col: str = "text", **trigger) -> StreamingQuery:
    """Adds each micro-batch of new documents to the index under ``path``; see add_batch()."""

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, checkpoint, options, id_col, text_col)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
