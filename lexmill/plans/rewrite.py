"""Synonyms: groups of words read from a file, and the rewriting of a query by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from lexmill.plans.query import And, Node, Not, Or, Term, fold

_BLANK = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def parse_synonyms(lines) -> dict[str, list[str]]:
    """Every word of a line stands for all of that line, in order of appearance, over all lines; not transitively."""
    out: dict[str, list[str]] = {}
    for line in lines:
        words = [w for w in (x.strip(_BLANK).translate(_LOWER) for x in line.split(",")) if w]
        if line.startswith("#") or len(words) < 2:
            continue
        for word in words:
            out[word] = list(dict.fromkeys([*out.get(word, []), *words]))
    return out


def load_synonyms(path: str, spark: SparkSession | None = None) -> dict[str, list[str]]:
    """From a local file, or with a session from any store; a file that is not there gives no synonyms."""
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return {}
        return parse_synonyms("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).split("\n"))
    try:
        with open(path, encoding="utf-8", errors="surrogateescape", newline="\n") as file:
            return parse_synonyms(file.read().split("\n"))
    except OSError:
        return {}


def rewrite(node: Node, synonyms: dict[str, list[str]]) -> Node:
    """Each term becomes a chain of OR over itself and its synonyms; phrases stay."""

    def expand(leaf: Term) -> Node:
        others = [Term(s) for s in synonyms.get(leaf.term, []) if s != leaf.term]
        return reduce(Or, others, leaf)

    return fold(node, expand, lambda p: p, And, Or, Not)
