"""Mixing sources to target weights by capped water-filling and seeded repetition.

Targets: every source gets ``level * weight`` words, but at most ``epochs`` times its own words; the level is where
the targets add up to the wanted total. That is the fixed point of clamping the sources above their limit and
sharing their excess among the others by weight. Copies: every document of a source is taken ``floor(target / words)``
times; of the rest, documents in seeded hash order are taken once more while their middle lies below the remainder, so
a source ends within half a document of its target. The order is a prefix sum in two levels, hash buckets and then the
one bucket at the edge, so that no task holds a whole source.

Null text has no words; null source is a source of its own, the last. Rows that repeat an id, null ids too, are rows of their own, each with
its own number of copies. An empty table gives no rows. Columns other than the three named are ignored by plan() and kept by mix().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, cut, drop, matched

#: Weights of the sources in the order of their code points, null last, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 2
SHARE = 1.5
SEED = "mix-1"
#: Rows of a bucket of the hash, about; buckets are a sixteenth smaller at each further digit.
ROWS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``; one row a source.

    A source is full when the level at which it fills, ``epochs * size / weight``, is not above the level that the
    sources not yet full would share. Both windows run over the sources only, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("double")
    out = sizes.select("source", "source_size", weight.alias("weight"))
    out = out.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("fills", F.col("cap") / F.col("weight"))
    ranked = Window.orderBy("fills", F.col("source").isNull(), F.encode("source", "UTF-8"))
    so_far = ranked.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("total", F.sum("source_size").over(every) * float(share))
    out = out.withColumn("room", F.col("total") - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0)))
    out = out.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0)))
    out = out.withColumn("level", F.col("room") / F.col("open"))
    # the first source, in filling order, that does not fill gives the level of all that follow
    level = F.min(F.when(F.col("fills") > F.col("level"), F.struct("fills", "level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * level["level"], F.col("cap")))
    return out.select("source", "source_size", "weight", target.alias("target"))


def _hashed(docs: DataFrame, id_col: str, text_col: str, seed: str, name: str) -> DataFrame:
    """``docs`` with the seeded hash that orders them; rows without an id are told apart by their text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return docs.withColumn(name, F.md5(F.concat_ws(":", F.lit(seed), own).cast("binary")))


def _levels(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, **how) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """A slim table of all rows, one row a source, the rows at the edges in order, and the digits of a bucket.

    One scan of the texts makes the slim table, written once. Sizes of hash buckets by source give the one bucket that a source's
    remainder ends in, and only its rows are put in order. Buckets are as many as keep one to some thousand rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _hashed(docs.select(F.col(id_col), F.col(source_col), F.col(text_col)), id_col, text_col, seed, "hash")
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.unhex(F.md5(text)).alias("digest"), "hash")
    rows = cut(rows, "sized")
    digits = max(1, math.ceil(math.log(max(rows.count() / ROWS, 1), 16)))
    bucket = F.substring("hash", 1, digits)
    per_bucket = cut(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "buckets")
    aims = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), **how)
    aims = aims.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = aims.select(F.col("source").alias("aim"), "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(aims.select(F.col("aim").alias("own"), "rest"), F.col("source").eqNullSafe(F.col("own")))
    edges = edges.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size"))).select(F.col("source").alias("s"), F.col("bucket").alias("edge"), "before")
    # a source without words has no such bucket
    aims = cut(aims.join(edges, F.col("aim").eqNullSafe(F.col("s")), "left").drop("s"), "aims")
    held = _aimed(rows, aims, "source").where(_at_edge("hash", digits))
    inside = Window.partitionBy("source").orderBy("hash", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2.0
    held = held.withColumn("copies", F.col("whole") + F.when(middle <= F.col("rest"), 1).otherwise(0))
    edge = cut(held.select("doc_id", "source", "size", "digest", "source_size", "target", "copies"), "edge")
    drop(per_bucket)
    return rows, aims, edge, digits


def _aimed(rows: DataFrame, aims: DataFrame, source: str) -> DataFrame:
    """Rows with what is aimed at for their source: one row a source, which goes to where the rows are."""
    return matched(rows, aims, F.col(source).eqNullSafe(F.col("aim")), "inner").drop("aim")


def _at_edge(hashed: str, digits: int) -> Column:
    return F.coalesce(F.substring(hashed, 1, digits) == F.col("edge"), F.lit(False))


def _elsewhere(hashed: str, digits: int) -> Column:
    """Copies of a row that is not in the bucket at the edge: one more before it, none behind it."""
    return F.col("whole") + F.when(F.coalesce(F.substring(hashed, 1, digits) < F.col("edge"), F.lit(True)), 1).otherwise(0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for every row of ``docs``."""
    rows, aims, edge, digits = _levels(docs, id_col, text_col, source_col, seed, **how)
    plain = _aimed(rows, aims, "source").where(~_at_edge("hash", digits)).withColumn("copies", _elsewhere("hash", digits))
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    return plain.select(*columns).unionByName(edge.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mixed table: the columns of ``docs``, every row as often as the mix takes it. No text is moved.

    A row away from the edge of its source has its copies from its own hash. One at the edge finds them by source, id and
    digest; of rows that agree in all three, as many as planned are taken once more.
    """
    kept = docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(kept))))  # no name of a column can clash with one of this module
    id_col, text_col, source_col = (f"c{kept.index(c)}" for c in (id_col, text_col, source_col))
    name = {x: f"own_{x}" for x in ("hash", "digest", "copies", "copy", "turn", "id", "source", "text", "more")}
    slim, aims, edge, digits = _levels(docs, id_col, text_col, source_col, seed, **how)
    drop(slim)
    rows = _aimed(_hashed(docs, id_col, text_col, seed, name["hash"]), aims, source_col)
    at_edge = _at_edge(name["hash"], digits)
    plain = rows.where(~at_edge).select(*docs.columns, _elsewhere(name["hash"], digits).alias(name["copies"]))
    held = rows.where(at_edge).select(*docs.columns, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias(name["digest"]))
    found = edge.groupBy("source", "doc_id", "digest").agg(F.min("copies").alias("least"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more"))
    found = found.select(F.col("source").alias(name["source"]), F.col("doc_id").alias(name["id"]), F.col("digest").alias(name["text"]), F.col("least").alias(name["copies"]), F.col("more").alias(name["more"]))
    same = F.col(source_col).eqNullSafe(F.col(name["source"])) & F.col(id_col).eqNullSafe(F.col(name["id"])) & (F.col(name["digest"]) == F.col(name["text"]))
    held = matched(held, cut(found, "found"), same, "inner")
    turn = F.row_number().over(Window.partitionBy(name["source"], name["id"], name["text"]).orderBy(F.lit(0)))
    held = held.withColumn(name["turn"], turn).select(*docs.columns, (F.col(name["copies"]) + F.when(F.col(name["turn"]) <= F.col(name["more"]), 1).otherwise(0)).alias(name["copies"]))
    both = plain.unionByName(held).where(F.col(name["copies"]) > 0)
    return both.withColumn(name["copy"], F.explode(F.array_repeat(F.lit(1), F.col(name["copies"]).cast("int")))).select(*docs.columns).toDF(*kept)
