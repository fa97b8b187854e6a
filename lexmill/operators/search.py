"""Boolean evaluation and ranking: one plan a query, made of a term filter, one aggregation a document, and a predicate.

The plan reads the postings of the query's terms, gathers per document which of them it holds (and their counts and
positions where needed), and evaluates the query tree as one Boolean column over these flags. Documents without any of the terms
come in only if the predicate holds for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import setops
from lexmill.operators.index import SearchIndex
from lexmill.plans.query import Node, Phrase, Term, fold, is_bag, leaves, parse, query_terms
from lexmill.plans.rewrite import rewrite

#: Terms up to which each has columns of its own; wider queries use maps.
WIDE = 200


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


class _Pivot:
    """Per-document columns for the distinct terms of a query."""

    def __init__(self, index: SearchIndex, node: Node):
        self.index = index
        self.terms = list(dict.fromkeys(query_terms(node)))
        self.number = {t: i for i, t in enumerate(self.terms)}
        phrases = [x for x in leaves(node) if isinstance(x, Phrase) and len(x.terms) > 1]
        self.placed = sorted({t for p in phrases for t in p.terms})
        self.wide = len(self.terms) > WIDE

    def rows(self) -> DataFrame:
        found = self.index.postings.where(F.col("term").isin(self.terms))
        if self.wide:
            entries = F.struct("term", F.struct("tf", "positions") if self.placed else F.struct("tf"))
            return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entries)).alias("found"))
        is_ = lambda t: F.col("term") == t
        tfs = [F.coalesce(F.max(F.when(is_(t), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for t, i in self.number.items()]
        places = [F.coalesce(F.first(F.when(is_(t), F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"at{self.number[t]}") for t in self.placed]
        return found.groupBy("doc_id").agg(*tfs, *places)

    def tf(self, term: str) -> Column:
        i = self.number[term]
        return F.coalesce(F.try_element_at("found", F.lit(term))["tf"], F.lit(0)) if self.wide else F.coalesce(F.col(f"tf{i}"), F.lit(0))

    def positions(self, term: str) -> Column:
        if self.wide:
            return F.coalesce(F.try_element_at("found", F.lit(term))["positions"], F.array().cast("array<int>"))
        return F.coalesce(F.col(f"at{self.number[term]}"), F.array().cast("array<int>"))

    def phrase(self, terms: tuple[str, ...]) -> Column:
        present = self.tf(terms[0]) > 0
        for t in dict.fromkeys(terms[1:]):
            present = present & (self.tf(t) > 0)
        if len(terms) == 1:
            return present

        def follows(p: Column) -> Column:
            out = F.lit(True)
            for i, t in enumerate(terms[1:], 1):
                out = out & F.array_contains(self.positions(t), p + i)
            return out

        return present & F.exists(self.positions(terms[0]), follows)

    def predicate(self, node: Node) -> Column:
        return fold(node, lambda x: self.tf(x.term) > 0, lambda x: self.phrase(x.terms), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def holds_for_empty(node: Node) -> bool:
    """Whether a document with none of the terms satisfies the query."""
    return fold(node, lambda _: False, lambda _: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def as_tree(index: SearchIndex, query: str | Node, synonyms: dict | None = None) -> Node:
    node = parse(query, index.options) if isinstance(query, str) else query
    return rewrite(node, synonyms) if synonyms else node


def boolean(index: SearchIndex, query: str | Node, synonyms: dict | None = None) -> DataFrame:
    """``doc_id`` of the documents that satisfy the query, without order."""
    node = as_tree(index, query, synonyms)
    pivot = _Pivot(index, node)
    rows = pivot.rows()
    if holds_for_empty(node):
        rows = index.universe().join(rows, "doc_id", "left")
    return rows.where(pivot.predicate(node)).select("doc_id")


def boolean_by_sets(index: SearchIndex, query: str | Node, mode: str = "gallop") -> DataFrame:
    """The same by set operations of the nodes' results, with a choice of intersection. AND uses ``mode``; phrases gallop."""
    node = as_tree(index, query)

    def phrase(x: Phrase) -> DataFrame:
        return boolean(index, x)

    def invert(ids: DataFrame) -> DataFrame:
        return setops.difference(index.universe(), ids)

    return fold(node, lambda x: index.lookup(x.term).select("doc_id"), phrase, lambda a, b: setops.intersect(a, b, mode), setops.unite, invert)


def phrase_matches(index: SearchIndex, terms: list[str], doc_id: int) -> bool:
    if not terms:
        return False
    only = SearchIndex(index.docs, index.postings.where(F.col("doc_id") == doc_id), index.term_stats, index.corpus_stats, index.options)
    return not boolean(only, Phrase(tuple(terms))).isEmpty()


def idf(n_docs: int, df: int) -> Column:
    return F.log1p(F.lit((n_docs - df + 0.5) / (df + 0.5)))


def scores(index: SearchIndex, rows: DataFrame, pivot: _Pivot, terms: list[str], params: Bm25) -> DataFrame:
    """``doc_id, score``: contributions are added in the order of the query, repeated terms again."""
    n, avgdl = index.stats()
    dfs = {r["term"]: r["df"] for r in index.term_stats.where(F.col("term").isin(pivot.terms)).collect()}
    norm = F.lit(params.k1) * (F.lit(1 - params.b) + F.lit(params.b) * (F.col("length") / F.lit(max(avgdl, 1e-9))))
    total = F.lit(0.0)
    for t in terms:
        tf = pivot.tf(t).cast("double")
        total = total + F.when(tf > 0, idf(n, dfs.get(t, 0)) * (tf * (params.k1 + 1) / (tf + norm))).otherwise(0.0)
    joined = rows.join(index.docs.select("doc_id", "length"), "doc_id")
    return joined.select("doc_id", total.alias("score")).where("score > 0")


def _best(ids: np.ndarray, scores: np.ndarray, k: int, last: bool) -> np.ndarray:
    """Rows that a ranking of ``k`` places may need; at the end, the places themselves in order.

    The edge is the ``k``-th highest score. Of rows at the edge, those with the least and those with the greatest ids may
    be needed: a row of another part can only lift the edge, and then no row of this one's edge counts.
    """
    edge = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    if not last:
        level = np.flatnonzero(scores == edge)
        level = level[np.argsort(ids[level], kind="stable")]
        return np.concatenate([np.flatnonzero(scores > edge), level if len(level) <= 2 * k else np.concatenate([level[:k], level[-k:]])])
    reach = np.flatnonzero(scores >= edge)
    first = reach[np.argsort(ids[reach], kind="stable")[:k]]
    chosen = np.union1d(np.flatnonzero(scores > edge), first)
    return chosen[np.lexsort((-ids[chosen], -scores[chosen]))[:k]]


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best by score and then greater id, where the last places among equals go to those with the least ids.

    One job: each task hands on at most three times ``k`` rows, and the last one ranks them.
    """

    def keep(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scores = np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                ids, scores = np.concatenate([ids, batch.column(0)]), np.concatenate([scores, batch.column(1)])
                rows = _best(ids, scores, k, False)
                ids, scores = ids[rows], scores[rows]
            rows = _best(ids, scores, k, last)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows].astype(np.int64)), pa.array(scores[rows])], ["doc_id", "score"])

        return run

    kind = "doc_id long, score double"
    slim = scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"))
    return slim.mapInArrow(keep(False), kind).repartition(1).mapInArrow(keep(True), kind)


def rank_terms(index: SearchIndex, terms: list[str], k: int = 10, candidates: DataFrame | None = None, params: Bm25 = Bm25()) -> DataFrame:
    """``doc_id, score`` of the best documents for a list of terms, among ``candidates`` if there are any."""
    spark = index.docs.sparkSession
    if not terms or k <= 0:
        return spark.createDataFrame([], "doc_id long, score double")
    node = None
    for t in terms:
        node = Term(t) if node is None else _or(node, Term(t))
    pivot = _Pivot(index, node)
    rows = pivot.rows()
    if candidates is not None and not candidates.isEmpty():
        rows = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    return top_k(scores(index, rows, pivot, terms, params), k)


def _or(a: Node, b: Node) -> Node:
    from lexmill.plans.query import Or

    return Or(a, b)


def bm25(index: SearchIndex, query: str | Node, k: int = 10, synonyms: dict | None = None, params: Bm25 = Bm25(), strict: bool = False) -> DataFrame:
    """``doc_id, score`` of the best documents.

    A query of terms and AND is ranked over all documents that hold any of them. Another query filters first; if nothing passes,
    the ranking falls back to the union, unless ``strict``.
    """
    node = as_tree(index, query, synonyms)
    terms = query_terms(node)
    if k <= 0:
        return index.docs.sparkSession.createDataFrame([], "doc_id long, score double")
    pivot = _Pivot(index, node)
    rows = pivot.rows()
    if not is_bag(node):
        passed = rows.where(pivot.predicate(node))
        # documents without any term may pass but never score; they only matter to whether something passed
        nothing = passed.isEmpty() and (not holds_for_empty(node) or index.universe().join(rows, "doc_id", "left_anti").isEmpty())
        if not nothing or strict:
            rows = passed
    return top_k(scores(index, rows, pivot, terms, params), k)


def with_paths(index: SearchIndex, hits: DataFrame) -> DataFrame:
    return hits.join(index.docs.select("doc_id", "path"), "doc_id")


def scan_predicate(tokens: Column, node: Node) -> Column:
    """The same query over a column of tokens, without an index."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return fold(node, lambda x: F.array_contains(tokens, x.term), lambda x: F.contains(line, F.lit(f" {' '.join(x.terms)} ")), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
