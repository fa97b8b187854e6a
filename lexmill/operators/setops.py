"""Set operations on document ids. The three intersections give equal results and differ in the join that they ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the shorter side of a galloping intersection is broadcast; its size is counted, not assumed.
BROADCAST_ROWS = 1_000_000
#: Neighbouring ids in one block of a skip list.
SKIP = 1024


def posting_docs(postings: DataFrame) -> DataFrame:
    return postings.select("doc_id").distinct()


def intersect_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides sorted and merged."""
    return a.hint("merge").join(b.hint("merge"), "doc_id", "left_semi").distinct()


def intersect_gallop(a: DataFrame, b: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The shorter side, if its counted size is within the limit, goes to where the longer one lies; else a merge."""
    sizes = [x.limit(limit + 1).count() for x in (a, b)]
    long, short = (b, a) if sizes[0] <= sizes[1] else (a, b)
    if min(sizes) > limit:
        return intersect_merge(a, b)
    return long.join(F.broadcast(short), "doc_id", "left_semi").distinct()


def skip_list(ids: DataFrame, width: int = SKIP) -> DataFrame:
    """``block, first, last, n`` for the blocks of ``width`` neighbouring ids that a list has ids in."""
    return ids.groupBy(F.floor(F.col("doc_id") / width).alias("block")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))


def intersect_skip(a: DataFrame, b: DataFrame, width: int = SKIP) -> DataFrame:
    """Blocks that only one side has ids in are skipped.

    The skip lists are joined first. Their common range becomes a condition on both sides, which reaches the scan of a
    stored index: its files are sorted by term and id, so row groups outside the range are not read. The rows of common blocks
    are then hashed.
    """
    x, y = skip_list(a, width).alias("x"), skip_list(b, width).alias("y")
    shared = x.join(y, "block").where(F.greatest("x.first", "y.first") <= F.least("x.last", "y.last"))
    ends = shared.agg(F.min(F.greatest("x.first", "y.first")).alias("low"), F.max(F.least("x.last", "y.last")).alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (1, 0)
    a, b = (d.select("doc_id").where(F.col("doc_id").between(low, high)) for d in (a, b))
    return a.join(b.hint("shuffle_hash"), "doc_id", "left_semi").distinct()


INTERSECT = {"two": intersect_merge, "gallop": intersect_gallop, "skip": intersect_skip}


def intersect(a: DataFrame, b: DataFrame, mode: str = "gallop") -> DataFrame:
    return INTERSECT.get(mode, intersect_gallop)(a, b)


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b, "doc_id", "left_anti")
