"""A corpus pipeline of five stages over ``documents``: toxic rows go, copies go, near copies go, sources are mixed, the rest is packed.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import common, exact_dedup, mixing, neardup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the threshold. Labels are those of the rows in ``docs``, less the held-out ones.

    Null and empty texts score as texts without evidence; without labelled rows of both classes nothing is toxic or everything is, as the labels
    say. Rows are judged one by one, so repeated rows stay or go together. An empty table stays empty.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the most code points and then the least id; a null id comes last.

    Null, empty and blank texts are one group. Of rows that repeat id and text one stays. An empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least id; a null id comes last. Texts without words are classes of their own."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them, so rows repeat and some go. A null source is a source; texts without words take nothing up."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences; a row that the mix repeats is packed as often. Null texts are empty and have the end only."""
    return packing.digests(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot train a classifier or run the tokenizer; tests/llm holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if held is not None:
            common.drop(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
