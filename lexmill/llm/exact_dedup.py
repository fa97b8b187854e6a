"""Exact deduplication as a stateful stream whose keyed state lives on disk and never expires.

The digest of every document (of its text without white space) is a small record; these records stream through an
aggregation keyed by digest whose state is kept in RocksDB, checkpointed to the shared folder, without a watermark.
The state of a digest is the best document seen so far: its length, its stable id and a content locator, with the
number of documents. The locator is the place of the record in the written table of digests. Where a digest was hit
more than once, the full bytes of all its texts are read again and compared; documents whose digest agrees but whose
bytes do not are regrouped by their bytes.

Ids are of any type that has an order. Null text is an empty text, so empty, blank and null texts are one group. Of equal texts the row with the most code
points in its original text stays, then the smallest id; null ids come last. Rows that repeat an id are rows of their
own: the locator tells them apart, and exactly one of them can be kept. An empty table gives no rows. Columns other
than the two named are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE, cut, drop, fresh_names, matched
from lexmill.sources.scratch import Folder, fresh_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Digest files that one micro-batch reads at most.
FILES_A_BATCH = 4096
#: Tasks that the rows of a large group are spread over.
TURNS = 16


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def bare(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _rank(chars: Column, key: Column, locator: Column) -> Column:
    """Least for the row that stays: most code points, an id before none, the least id, the first place."""
    return F.struct((-chars).alias("turned"), key.isNull().alias("none"), key.alias("key"), locator.alias("locator"))


def _grouped(records: DataFrame, *by: str) -> DataFrame:
    """The row that stays of each group, and the group's size; added up in each task before the shuffle."""
    return records.groupBy(*by).agg(F.min(_rank(F.col("chars"), F.col("key"), F.col("locator"))).alias("best"), F.count(F.lit(1)).alias("group_size"))


@contextmanager
def _on_disk(spark: SparkSession):
    held, conf = {}, {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.unloadOnCommit": "true", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in conf.items():
        held[k] = spark.conf.get(k, None)
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup_stream(records: DataFrame) -> DataFrame:
    """Streaming ``digest -> best, group_size`` over a stream of ``digest, chars, key, locator`` records."""
    return _grouped(records, "digest")


def run_stream(records: DataFrame, sink: str, checkpoint: str) -> None:
    """Runs the stream until it has read what there is. Each micro-batch appends the groups that it changed, with its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={number:09d}")

    with _on_disk(records.sparkSession):
        query = dedup_stream(records).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest, chars`` for every row of ``docs``."""
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    records = picked.select(digest(bare(F.col("words"))).alias("digest"), F.length("words").cast("long").alias("chars"), "key")
    # the locator is written with the record, so it stays what it is wherever the rows are computed again
    records = cut(records.withColumn("locator", F.monotonically_increasing_id()), "digests")
    state = fresh_path(spark, "groups")
    folders = {f.rsplit("/", 1)[0] for f in records.inputFiles()}
    groups = None
    if folders:
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(next(iter(folders)))
        run_stream(stream, state, f"{state}-state")
        groups = _read_groups(spark, state)
    if groups is None:
        groups = _grouped(records, "digest")
    # only groups of several rows are looked up; a large one is spread over several tasks
    groups = cut(groups.where("group_size > 1"), "hits")
    differ = collisions(picked, groups, digest)
    if differ.isEmpty():
        rows = _judged(records, groups, ["digest"])
    else:
        again = matched(picked.withColumns({"digest": digest(bare(F.col("words"))), "chars": F.length("words").cast("long")}), differ, "digest", "left_semi")
        again = cut(again.select("digest", "chars", "key", bare(F.col("words")).alias("bytes")).withColumn("locator", F.monotonically_increasing_id()), "regrouped")
        rows = _judged(matched(records, differ, "digest", "left_anti"), groups, ["digest"])
        rows = rows.unionByName(_judged(again, _grouped(again, "digest", "bytes").where("group_size > 1"), ["digest", "bytes"]))
    rows = cut(rows, "judged")
    drop(records, groups, differ)
    if folders:
        store = Folder(spark, state)
        for path in (state, f"{state}-state"):
            store.remove(path)
    return rows


def _judged(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    groups = groups.select(*(F.col(c).alias(f"g_{c}") for c in by), "best", "group_size", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("turn"))
    met = [*(F.col(c) == F.col(f"g_{c}") for c in by), F.pmod("locator", F.lit(TURNS)) == F.col("turn")]
    alone = F.col("best").isNull()
    joined = rows.join(groups, met, "left")
    return joined.select(
        F.col("key").alias("doc_id"), F.when(alone, F.col("key")).otherwise(F.col("best.key")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("locator") == F.col("best.locator"))).alias("kept"), "digest", "chars",
    )


def _read_groups(spark: SparkSession, state: str) -> DataFrame | None:
    """The last word on every digest: of the micro-batches that changed it, the latest, whose group is the largest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    kinds = spark.read.option("basePath", state).parquet(f"{state}/batch=*").drop("batch")
    return kinds.groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("last")).select("digest", "last.best", "last.group_size")


def collisions(picked: DataFrame, groups: DataFrame, digest=sha256) -> DataFrame:
    """Digests that texts with other bytes share, of those in ``groups``, which were hit more than once.

    Of each, the least and greatest of the full texts are compared. As long as the digests hit are few, texts that were
    not hit stay where they are, and those that were are reduced to two a task and digest before they are moved.
    """
    texts = picked.select(bare(F.col("words")).alias("bytes")).withColumn("digest", digest(F.col("bytes")))
    ends = matched(texts, groups.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
    return cut(ends.where("least <> most").select("digest"), "collisions")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    Rows are told by id, digest and length; of rows that agree in all three, one stays if that is the row to keep.
    """
    said = exact_dedup(docs, id_col, text_col).groupBy("doc_id", "digest", "chars").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    name = fresh_names(docs, "digest", "chars", "id", "other", "length")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({name["digest"]: sha256(bare(text)), name["chars"]: F.length(text).cast("long")})
    named = said.select(F.col("doc_id").alias(name["id"]), F.col("digest").alias(name["other"]), F.col("chars").alias(name["length"]), "stays", "n")
    same = docs[id_col].eqNullSafe(F.col(name["id"])) & (F.col(name["digest"]) == F.col(name["other"])) & (F.col(name["chars"]) == F.col(name["length"]))
    out = matched(rows, named.where("not stays or n > 1").drop("stays", "n"), same, "left_anti")
    again = named.where("stays and n > 1").drop("stays", "n")
    if not again.isEmpty():
        out = out.unionByName(matched(rows, again, same, "left_semi").dropDuplicates([id_col, name["digest"], name["chars"]]))
    return out.select(*docs.columns)
