"""The registered search queries over ``documents`` and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import codecs
from lexmill.functions.stemmer import STEP_2, STEP_3, STEP_4, stem
from lexmill.functions.text import STOPWORDS, TextOptions, tokens
from lexmill.operators import search, setops
from lexmill.operators.batch import rank_many
from lexmill.operators.index import SearchIndex, build_index, numbered, rank_positions
from lexmill.operators.search import Bm25
from lexmill.plans.query import QueryError
from lexmill.plans.rewrite import parse_synonyms
from lexmill.sources import binary_index, store
from lexmill.sources.scratch import fresh_path
from lexmill.streaming.incremental import add_batch

SYNONYMS = {"thing": ["thing", "ering", "nicht"], "ering": ["thing", "ering", "nicht"], "nicht": ["thing", "ering", "nicht"]}
BOOLEAN = {
    "bool_term": "nicht",
    "bool_and": "the AND license",
    "bool_juxtaposition": "the and with",
    "bool_or": "license OR nicht",
    "bool_not": "the AND NOT with",
    "bool_nested": "(license OR nicht) AND NOT (der OR in)",
    "bool_not_missing": "NOT zzzunicorn",
    "phrase_2": '"of the"',
    "phrase_3": '"of the the"',
    "phrase_repeated": '"the the"',
    "phrase_and_term": '"in the" AND with AND NOT "to be"',
}
# Small corpora with what their queries find, queries with where their errors are, and lines of a file of synonyms.
SMALL = (
    (("cats love milk", "dogs and cats play", "milk and honey"), (("cats AND milk", (0,)), ("dogs OR honey", (1, 2)), ("cats AND NOT milk", (1,)), ("(dogs OR honey) AND milk", (2,)), ("unicorn", ()), ("NOT unicorn", (0, 1, 2)))),
    (("cats love milk", "cats drink milk love"), (('"cats love"', (0,)), ('"milk love"', (1,)))),
    (("the quick brown fox", "quick fox brown"), (('"quick brown fox"', (0,)),)),
)
ERRORS = (('  a "b', 4), ("  ", 0), ("(a OR b", 0), ("a ((b", 3), ("x !!!", 2), ('"  "', 0), ("a AND", 5), ("(", 1), ("NOT", 3), (")", 0), ("()", 1), ("AND a", 0), ("a OR OR b", 5), ("a )", 2))
SYNONYM_LINES = ("# of cats", "Cat, kitten,feline", "solo", "cat,tom", "dog,puppy")
RANKED = {
    "bm25_terms": ("the of", 10, Bm25(), None),
    "bm25_duplicate_term": ("license license nicht", 20, Bm25(), None),
    "bm25_or_filtered": ("license OR nicht", 25, Bm25(), None),
    "bm25_phrase_filtered": ('"of the" AND with', 15, Bm25(), None),
    "bm25_not": ("the AND NOT with", 15, Bm25(), None),
    "bm25_empty_fallback": ("license AND NOT license", 12, Bm25(), None),
    "bm25_params": ("from with", 10, Bm25(0.9, 0.4), None),
    "bm25_topk_ties": ("nicht license", 17, Bm25(1.2, 0.0), None),
    "synonym_bm25": ("thing AND der", 20, Bm25(), SYNONYMS),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_stored: dict[tuple, str] = {}


def index_of(spark: SparkSession, sf_dir: str, options: TextOptions = TextOptions()) -> SearchIndex:
    """The stored index of the documents: built and saved by the first query of a session that asks for it, loaded by all."""
    key = (spark.sparkContext.applicationId, sf_dir, options)
    if key not in _stored:
        path = fresh_path(spark, "index")
        store.save_index(build_index(documents(spark, sf_dir), options), path)
        _stored[key] = path
    return store.load_index(spark, _stored[key])


def built(spark: SparkSession, sf_dir: str, options: TextOptions = TextOptions()) -> SearchIndex:
    """The index as a plan, for the queries that are about building it."""
    return build_index(documents(spark, sf_dir), options)


def _ranked(hits: DataFrame) -> DataFrame:
    """The few best hits with their places; scores are rounded for comparison only after the ranking."""
    order = Window.orderBy(F.desc("score"), F.desc("doc_id"))
    return hits.select("doc_id", F.round("score", 6).alias("score"), F.row_number().over(order).alias("rank"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.bm25(index_of(spark, sf_dir), "the of"))


def _boolean(name: str):
    return lambda spark, sf_dir: search.boolean(index_of(spark, sf_dir), BOOLEAN[name])


def _bm25(name: str):
    query, k, params, synonyms = RANKED[name]
    return lambda spark, sf_dir: _ranked(search.bm25(index_of(spark, sf_dir), query, k, synonyms, params))


def _joined(column: str):
    return F.array_join(column, " ")


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _joined(tokens(F.col("text"))).alias("tokens"))


def tokenize_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", _joined(tokens(F.col("text"), TextOptions(remove_stopwords=True))).alias("tokens"))


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).docs.select("doc_id", "length")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).postings.select("term", "doc_id", "tf", F.concat_ws(" ", F.col("positions").cast("array<string>")).alias("positions"))


def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).term_stats.select("term", "df")


def term_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.where(F.col("term").isin("the", "license", "nicht")).select("term", "doc_id", "tf")


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).corpus_stats.select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


def phrase_stopworded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions count after the stopwords are gone, so the phrase also matches texts with stopwords between its words."""
    return search.boolean(index_of(spark, sf_dir, TextOptions(remove_stopwords=True)), '"er the er"')


def scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested query and a phrase without an index."""
    node = search.parse('(license OR nicht OR "of the") AND NOT (der OR "in the")')
    rows = documents(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("tokens"))
    return rows.where(search.scan_predicate(F.col("tokens"), node)).select("doc_id")


def _sets(operation):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = index_of(spark, sf_dir)
        return operation(index.lookup("the").select("doc_id"), index.lookup("and").select("doc_id"))

    return run


def posting_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.posting_docs(index_of(spark, sf_dir).lookup("the"))


def bool_by_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.boolean_by_sets(index_of(spark, sf_dir), '(the AND with OR nicht) AND NOT "of the"', "two")


def synonym_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.boolean(index_of(spark, sf_dir), "thing AND NOT the", SYNONYMS)


def bm25_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents that hold one of the terms, in one job with other queries."""
    index = index_of(spark, sf_dir)
    asked = spark.createDataFrame([(1, ["the", "and"]), (2, ["license", "license", "nicht"]), (3, ["from"])], "query_id int, terms array<string>")
    return rank_many(index, asked, k=None).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def delta_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_of(spark, sf_dir).postings
    return rows.select("term", "doc_id", F.concat_ws(" ", codecs.delta_encode(F.col("positions")).cast("array<string>")).alias("gaps"))


def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_of(spark, sf_dir).postings
    back = codecs.delta_decode(codecs.delta_encode(F.col("positions")))
    return rows.select("term", "doc_id", F.concat_ws(" ", back.cast("array<string>")).alias("positions"))


def varbyte_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", codecs.varbyte_size(F.col("n_chars")).alias("n_bytes"))


def varbyte_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting's positions, coded and decoded, with the bytes they take."""
    data = codecs.compress(F.col("positions"))
    rows = index_of(spark, sf_dir).postings
    return rows.select("term", "doc_id", F.length(data).alias("n_bytes"), F.concat_ws(" ", codecs.decompress(data).cast("array<string>")).alias("positions"))


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("term", "doc_id", "tf", F.concat_ws(" ", F.col("positions").cast("array<string>")).alias("positions"))


def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return index.term_stats.select("term", "df", "cf").crossJoin(F.broadcast(index.corpus_stats.select("n_docs", "total_len")))


def batch_added_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made of three batches: half of the documents, all of them, and the second batch once more."""
    path, docs = fresh_path(spark, "batches"), documents(spark, sf_dir)
    for number, rows in ((0, docs.where("doc_id % 2 = 0")), (1, docs), (1, docs)):
        add_batch(rows, number, path, "all")
    index = store.load_index(spark, path)
    return index.postings.select("term", "doc_id", "tf").join(index.term_stats.select("term", "df"), "term")


def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of the benchmark's texts after both versions of the single-file format."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    made = numbered(items, "item_id").select("doc_id", "item_id", "text")
    out = []
    for version in (1, 2):
        back = binary_index.from_bytes(spark, binary_index.to_bytes(build_index(made, path_col="item_id"), version))
        rows = back.postings.join(back.docs.select("doc_id", F.col("path").cast("long").alias("item_id")), "doc_id")
        out.append(rows.select(F.lit(version).alias("version"), "term", "item_id", "tf", F.concat_ws(" ", F.col("positions").cast("array<string>")).alias("positions")))
    return out[0].unionByName(out[1])


def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids 0, 1, 2 ... in the order of the documents' own, turned round."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("was"), (-F.col("doc_id")).alias("order"))
    return numbered(rows, "order").select("doc_id", "was")


def skip_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.skip_list(index_of(spark, sf_dir).lookup("the").select("doc_id"), 16).select("block", "first", "last", F.col("n").alias("ids"))


def synonym_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, " ".join(v)) for k, v in parse_synonyms(SYNONYM_LINES).items()]
    return spark.createDataFrame(rows, "word string, means string")


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text, *_ in ERRORS:
        try:
            search.parse(text)
        except QueryError as error:
            rows.append((text, error.offset))
    return spark.createDataFrame(rows, "query string, place int")


def small_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What Boolean queries find in corpora of a few lines, by one plan and by set operations with each intersection."""
    out = []
    for texts, asked in SMALL:
        index = build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        for query, _ in asked:
            found = [search.boolean(index, query), *(search.boolean_by_sets(index, query, mode) for mode in setops.INTERSECT)]
            out += [ids.select(F.lit(query).alias("query"), F.lit(i).alias("way"), "doc_id") for i, ids in enumerate(found)]
    return reduce(DataFrame.unionByName, out)


def compressed_index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of document ids and of positions over all terms of the compressed format."""
    sized = index_of(spark, sf_dir).postings.select("term", "doc_id", codecs.compressed_size(F.col("positions")).alias("size"))
    rows = rank_positions(sized)
    return rows.agg(F.sum(codecs.varbyte_size(F.col("gap"))).alias("id_bytes"), F.sum("size").alias("position_bytes"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type")
    return rows.agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term with its stem: the stemmer sees each term once."""
    terms = index_of(spark, sf_dir).term_stats.select("term")

    @F.pandas_udf("string")
    def stems(column):
        return column.map(stem)

    return terms.withColumn("stem", stems("term"))


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(search.bm25(index_of(spark, sf_dir, TextOptions(stem=True)), "licensed things"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (tokenize, tokenize_stopwords, doc_length, postings, term_df, term_tf, corpus_stats, phrase_stopworded, scan_nested, posting_docs, bool_by_sets, synonym_bool, bm25_all_scores, delta_gaps, delta_decode, varbyte_size, varbyte_round_trip, stored_postings, stored_statistics, batch_added_postings, binary_round_trip, dense_ids, skip_blocks, synonym_lines, parse_errors, small_corpora, compressed_index_size, percentiles, stem_vocab, bm25_stemmed)
    sets = {"intersect_two": setops.intersect_merge, "intersect_gallop": setops.intersect_gallop, "intersect_skip": setops.intersect_skip, "unite": setops.unite, "difference": setops.difference}
    return {f.__name__: f for f in plain} | {n: _boolean(n) for n in BOOLEAN} | {n: _bm25(n) for n in RANKED} | {n: _sets(f) for n, f in sets.items()}


# SQL

_TOK = "SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM documents"
_STOP = "SELECT doc_id, list_filter(t, lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in STOPWORDS) + f")) AS t FROM ({_TOK})"
_POSTINGS = f"SELECT term, doc_id, count(*) AS tf, list(p ORDER BY p) AS ps FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM ({_TOK})) GROUP BY term, doc_id"


def _has(*words: str) -> str:
    return "contains(' ' || array_to_string(t, ' ') || ' ', ' " + " ".join(words) + " ')"


_CONDITIONS = {
    "bool_term": _has("nicht"),
    "bool_and": f"{_has('the')} AND {_has('license')}",
    "bool_juxtaposition": f"{_has('the')} AND {_has('with')}",
    "bool_or": f"{_has('license')} OR {_has('nicht')}",
    "bool_not": f"{_has('the')} AND NOT {_has('with')}",
    "bool_nested": f"({_has('license')} OR {_has('nicht')}) AND NOT ({_has('der')} OR {_has('in')})",
    "bool_not_missing": f"NOT {_has('zzzunicorn')}",
    "phrase_2": _has("of", "the"),
    "phrase_3": _has("of", "the", "the"),
    "phrase_repeated": _has("the", "the"),
    "phrase_and_term": f"{_has('in', 'the')} AND {_has('with')} AND NOT {_has('to', 'be')}",
    "scan_nested": f"({_has('license')} OR {_has('nicht')} OR {_has('of', 'the')}) AND NOT ({_has('der')} OR {_has('in', 'the')})",
    "bool_by_sets": f"({_has('the')} AND {_has('with')} OR {_has('nicht')}) AND NOT {_has('of', 'the')}",
    "synonym_bool": f"({_has('thing')} OR {_has('ering')} OR {_has('nicht')}) AND NOT {_has('the')}",
    "intersect_two": f"{_has('the')} AND {_has('and')}",
    "intersect_gallop": f"{_has('the')} AND {_has('and')}",
    "intersect_skip": f"{_has('the')} AND {_has('and')}",
    "unite": f"{_has('the')} OR {_has('and')}",
    "difference": f"{_has('the')} AND NOT {_has('and')}",
    "posting_docs": _has("the"),
}


def _stem_sql(terms: str) -> str:
    """A common table ``stems (term, stem)`` for a query of terms; each step of the stemmer is a query over the last one's."""
    cut = lambda w, n: f"left({w}, -{n})" if n else w
    # a y counts as a vowel unless a vowel stands before it
    shape = lambda w: f"list_reduce(list_prepend('', string_split({w}, '')), lambda a, c: a || CASE WHEN c = '' THEN '' WHEN contains('aeiou', c) OR (c = 'y' AND right(a, 1) <> 'V') THEN 'V' ELSE 'C' END)"
    measure = lambda w: f"len(regexp_extract_all({shape(w)}, 'V+C'))"
    closed = lambda w: f"regexp_matches({w}, '[^aeiou][aeiou][^aeiouwxy]$')"
    ends = lambda w, x: f"ends_with({w}, '{x}')"
    swap = lambda rules: "CASE " + " ".join(f"WHEN {ends('w', a)} THEN CASE WHEN {measure(cut('w', len(a)))} > 0 THEN {cut('w', len(a))} || '{b}' ELSE w END" for a, b in rules) + " ELSE w END"
    dropped = [(f"{ends('w', x)} AND {measure(cut('w', len(x)))} > 1", cut("w", len(x))) for x in STEP_4]
    dropped.append((f"(ends_with(w, 'sion') OR ends_with(w, 'tion')) AND {measure(cut('w', 3))} > 1", cut("w", 3)))
    steps = [
        f"CASE WHEN {ends('w', 'sses')} OR {ends('w', 'ies')} THEN {cut('w', 2)} WHEN regexp_matches(w, '[^s]s$') THEN {cut('w', 1)} ELSE w END",
        f"""CASE WHEN {ends('w', 'eed')} THEN CASE WHEN {measure(cut('w', 3))} > 0 THEN {cut('w', 1)} ELSE w END
            WHEN NOT regexp_matches(w, '[aeiouy].*(ed|ing)$') THEN w
            WHEN regexp_matches(rest, '(at|bl|iz)$') THEN rest || 'e'
            WHEN len(rest) > 1 AND right(rest, 1) = rest[-2] AND NOT regexp_matches(rest, '[lsz]$') THEN {cut('rest', 1)}
            WHEN {measure('rest')} = 1 AND {closed('rest')} THEN rest || 'e' ELSE rest END""",
        f"CASE WHEN regexp_matches(w, '[aeiouy].*y$') THEN {cut('w', 1)} || 'i' ELSE w END",
        swap(STEP_2),
        swap(STEP_3),
        "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in dropped) + " ELSE w END",
        f"CASE WHEN {ends('w', 'e')} AND ({measure(cut('w', 1))} > 1 OR ({measure(cut('w', 1))} = 1 AND NOT {closed(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END",
        f"CASE WHEN {ends('w', 'll')} AND {measure('w')} > 1 THEN {cut('w', 1)} ELSE w END",
    ]
    out = f"s0 AS (SELECT term, regexp_replace(term, '[^a-z]', '', 'g') AS w FROM ({terms}))"
    for i, step in enumerate(steps):
        out += f", s{i + 1} AS (SELECT term, CASE WHEN len(w) < 3 AND {i} = 0 THEN w WHEN short THEN w ELSE {step} END AS w, short FROM (SELECT *, CASE WHEN ends_with(w, 'ed') THEN left(w, -2) ELSE left(w, -3) END AS rest{', len(w) < 3 AS short' if i == 0 else ''} FROM s{i}))"
    return out + f", stems AS (SELECT term, w AS stem FROM s{len(steps)})"


def _score_sql(terms: list[str], params: Bm25) -> str:
    tf = lambda w: f"list_count(list_filter(t, lambda x: x = '{w}'))"
    names = {w: f"f{i}" for i, w in enumerate(dict.fromkeys(terms))}
    counts = ", ".join(f"{tf(w)} AS {n}" for w, n in names.items())
    dfs = ", ".join(f"count(*) FILTER ({n} > 0) AS d{n}" for n in names.values())
    norm = f"({params.k1}::DOUBLE * ({1 - params.b}::DOUBLE + {params.b}::DOUBLE * (len(t) / greatest(avgdl, 1e-9))))"
    parts = " + ".join(f"CASE WHEN {names[w]} > 0 THEN ln(1 + (n - d{names[w]} + 0.5) / (d{names[w]} + 0.5)) * ({names[w]} * {params.k1 + 1}::DOUBLE / ({names[w]} + {norm})) ELSE 0 END" for w in terms)
    return f"""
c AS (SELECT doc_id, t, {counts} FROM tok),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl, {dfs} FROM c),
scored AS (SELECT doc_id, t, 0.0::DOUBLE + {parts} AS score FROM c, s)"""


def _ranked_sql(terms: list[str], k: int, params: Bm25, condition: str | None) -> str:
    chosen = "SELECT doc_id, score FROM scored WHERE score > 0"
    if condition:
        chosen += f" AND (({condition}) OR NOT EXISTS (SELECT 1 FROM scored WHERE {condition}))"
    return f"""
WITH tok AS ({_TOK}), {_score_sql(terms, params)},
chosen AS ({chosen}),
edge AS (SELECT min(score) AS e FROM (SELECT score FROM chosen ORDER BY score DESC LIMIT {k})),
kept AS (
    SELECT doc_id, score FROM chosen, edge WHERE score > e
    UNION SELECT doc_id, score FROM (SELECT doc_id, score FROM chosen, edge WHERE score >= e ORDER BY doc_id LIMIT {k}))
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY raw DESC, doc_id DESC) AS rank
FROM (SELECT doc_id, score, score AS raw FROM kept ORDER BY score DESC, doc_id DESC LIMIT {k})"""


def oracle_sql() -> dict[str, str]:
    size = lambda v: f"(CASE WHEN {v} < 128 THEN 1 WHEN {v} < 16384 THEN 2 WHEN {v} < 2097152 THEN 3 WHEN {v} < 268435456 THEN 4 ELSE 5 END)"
    gaps = "list_transform(range(1, len(ps) + 1), lambda i: ps[i] - CASE WHEN i = 1 THEN 0 ELSE ps[i - 1] END)"
    bytes_ = f"list_sum(list_transform({gaps}, lambda g: {size('g')}))"
    out = {
        "tokenize": f"SELECT doc_id, array_to_string(t, ' ') AS tokens FROM ({_TOK})",
        "tokenize_stopwords": f"SELECT doc_id, array_to_string(t, ' ') AS tokens FROM ({_STOP})",
        "doc_length": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS length FROM ({_TOK})",
        "postings": f"SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(ps, ' ') AS positions FROM ({_POSTINGS})",
        "term_df": f"SELECT term, count(*) AS df FROM ({_POSTINGS}) GROUP BY term",
        "term_tf": f"SELECT term, doc_id, CAST(tf AS INTEGER) AS tf FROM ({_POSTINGS}) WHERE term IN ('the', 'license', 'nicht')",
        "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total_len, round(avg(len(t)), 6) AS avgdl FROM ({_TOK})",
        "phrase_stopworded": f"SELECT doc_id FROM ({_STOP}) WHERE {_has('er', 'er')}",
        "delta_gaps": f"SELECT term, doc_id, array_to_string({gaps}, ' ') AS gaps FROM ({_POSTINGS})",
        "delta_decode": f"SELECT term, doc_id, array_to_string(ps, ' ') AS positions FROM ({_POSTINGS})",
        "varbyte_size": f"SELECT doc_id, CAST({size('n_chars')} AS INTEGER) AS n_bytes FROM documents",
        "varbyte_round_trip": f"SELECT term, doc_id, CAST({bytes_} AS INTEGER) AS n_bytes, array_to_string(ps, ' ') AS positions FROM ({_POSTINGS}) ",
        "stored_postings": f"SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, array_to_string(ps, ' ') AS positions FROM ({_POSTINGS})",
        "stored_statistics": f"WITH t AS ({_TOK}), c AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total_len FROM t) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, n_docs, total_len FROM ({_POSTINGS}), c GROUP BY term, n_docs, total_len",
        "batch_added_postings": f"SELECT term, doc_id, CAST(tf AS INTEGER) AS tf, count(*) OVER (PARTITION BY term) AS df FROM ({_POSTINGS})",
        "binary_round_trip": f"SELECT CAST(version AS INTEGER) AS version, term, doc_id AS item_id, CAST(tf AS INTEGER) AS tf, array_to_string(ps, ' ') AS positions FROM ({_POSTINGS.replace('documents', 'benchmark').replace('SELECT doc_id, list_transform', 'SELECT item_id AS doc_id, list_transform')}), (SELECT unnest([1, 2]) AS version)",
        "dense_ids": "SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS doc_id, doc_id AS was FROM documents",
        "skip_blocks": f"SELECT doc_id // 16 AS block, min(doc_id) AS first, max(doc_id) AS last, count(*) AS ids FROM ({_TOK}) WHERE {_has('the')} GROUP BY 1",
        "synonym_lines": "SELECT * FROM (VALUES ('cat', 'cat kitten feline tom'), ('kitten', 'cat kitten feline'), ('feline', 'cat kitten feline'), ('tom', 'cat tom'), ('dog', 'dog puppy'), ('puppy', 'dog puppy')) AS v(word, means)",
        "parse_errors": "SELECT query, CAST(place AS INTEGER) AS place FROM (VALUES " + ", ".join(f"('{q}', {at})" for q, at in ERRORS) + ") AS v(query, place)",
        "small_corpora": "SELECT query, CAST(way AS INTEGER) AS way, CAST(doc_id AS BIGINT) AS doc_id FROM (VALUES " + ", ".join(f"('{q}', {d})" for _, asked in SMALL for q, ids in asked for d in ids) + ") AS v(query, doc_id), (SELECT unnest(range(4)) AS way)",
        "stem_vocab": f"WITH {_stem_sql(f'SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM ({_TOK}))')} SELECT term, stem FROM stems",
        "compressed_index_size": f"SELECT CAST(sum({size('gap')}) AS BIGINT) AS id_bytes, CAST(sum({bytes_}) AS BIGINT) AS position_bytes FROM (SELECT ps, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM ({_POSTINGS}))",
        "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    }
    out |= {n: f"SELECT doc_id FROM ({_TOK}) WHERE {c}" for n, c in _CONDITIONS.items()}
    ranked = {
        "bm25_terms": (["the", "of"], None),
        "bm25_duplicate_term": (["license", "license", "nicht"], None),
        "bm25_or_filtered": (["license", "nicht"], _CONDITIONS["bool_or"]),
        "bm25_phrase_filtered": (["of", "the", "with"], f"{_has('of', 'the')} AND {_has('with')}"),
        "bm25_not": (["the", "with"], _CONDITIONS["bool_not"]),
        "bm25_empty_fallback": (["license", "license"], "false"),
        "bm25_params": (["from", "with"], None),
        "bm25_topk_ties": (["nicht", "license"], None),
        "synonym_bm25": (["thing", "ering", "nicht", "der"], f"({_has('thing')} OR {_has('ering')} OR {_has('nicht')}) AND {_has('der')}"),
    }
    for name, (terms, condition) in ranked.items():
        out[name] = _ranked_sql(terms, RANKED[name][1], RANKED[name][2], condition)
    stemmed = f"SELECT doc_id, coalesce(list(stem ORDER BY p) FILTER (stem <> ''), []) AS t FROM ({_TOK}) LEFT JOIN (SELECT doc_id, p, stem FROM (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM ({_TOK})) JOIN stems USING (term)) USING (doc_id) GROUP BY doc_id"
    out["bm25_stemmed"] = _ranked_sql(["licens", "thing"], 10, Bm25(), None).replace(f"WITH tok AS ({_TOK})", f"WITH {_stem_sql(f'SELECT DISTINCT term FROM (SELECT unnest(t) AS term FROM ({_TOK}))')}, tok AS ({stemmed})")
    scored = [f"SELECT {i} AS query_id, doc_id, round(score, 6) AS score FROM (WITH tok AS ({_TOK}), {_score_sql(t, Bm25())} SELECT doc_id, score FROM scored WHERE score > 0)" for i, t in ((1, ["the", "and"]), (2, ["license", "license", "nicht"]), (3, ["from"]))]
    out["bm25_all_scores"] = " UNION ALL ".join(scored)
    return out


