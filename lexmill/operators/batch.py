"""Many ranked queries in one job: the queries are a table, joined with the postings by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.index import SearchIndex
from lexmill.operators.search import Bm25

#: Query terms up to which the table of queries goes to where the postings are; their number is counted, not assumed.
BROADCAST_ROWS = 200_000


def rank_many(index: SearchIndex, queries: DataFrame, k: int | None = 10, params: Bm25 = Bm25()) -> DataFrame:
    """``query_id, rank, doc_id, score`` for ``queries (query_id, terms array<string>)``, over the union of each one's terms;
    without ``k`` all hits, which have no rank then.

    Every posting read is joined with the queries that ask for its term; contributions are added per query and document in
    the order of the terms. As long as the queries' terms are few they are broadcast, so postings of a frequent term stay where
    they lie; beyond that, both sides are dealt by term, and adaptive execution splits the frequent ones.
    """
    n, avgdl = index.stats()
    asked = queries.select("query_id", F.posexplode("terms").alias("place", "term"))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    asked = asked.join(index.term_stats, "term").withColumn("idf", F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    hits = index.postings.select("term", "doc_id", "tf").join(F.broadcast(asked) if few else asked, "term").join(index.docs.select("doc_id", "length"), "doc_id")
    norm = F.lit(params.k1) * (F.lit(1 - params.b) + F.lit(params.b) * (F.col("length") / F.lit(max(avgdl, 1e-9))))
    part = F.col("idf") * (F.col("tf") * (params.k1 + 1) / (F.col("tf") + norm))
    ordered = F.array_sort(F.collect_list(F.struct("place", part.alias("part"))))
    scored = hits.groupBy("query_id", "doc_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))
    if k is None:
        return scored.select("query_id", "doc_id", "score")
    # each task keeps the best k of a query before the rows of a query meet
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
