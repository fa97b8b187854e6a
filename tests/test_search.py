"""The search engine against its own definitions, small corpora, and SQL."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill import cli
from lexmill.functions import codecs
from lexmill.functions.stemmer import stem
from lexmill.functions.text import TextOptions, tokenize, tokens
from lexmill.operators import search, setops
from lexmill.operators.index import build_index, numbered
from lexmill.plans import queries
from lexmill.plans.query import And, Not, Or, Phrase, QueryError, Term, parse, query_terms
from lexmill.plans.rewrite import load_synonyms, parse_synonyms, rewrite
from lexmill.sources import binary_index, corpus, store
from lexmill.streaming.incremental import add_batch, index_stream

FILES = ["Cats love milk and cream.", "Dogs and cats play outside.", "Machine learning ranks search results with BM25.", "The quick brown fox jumps over the lazy dog.", "Phrase search needs adjacent token positions."]
TINY = ["cats love milk", "dogs and cats play", "milk and honey"]


def index(spark, texts, **options):
    return build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TextOptions(**options))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def hits(df):
    return [(r["doc_id"], r["score"]) for r in df.orderBy(F.desc("score"), F.desc("doc_id")).collect()]


@pytest.mark.parametrize("text,options,want", [("Cats LOVE Milk", {}, "cats love milk"), ("hello, world! foo-bar.", {}, "hello world foo bar"), ("the cat and the dog", {"remove_stopwords": True}, "cat dog"), ("running cats", {"stem": True}, "run cat"), ("bm25 score 42", {"stem": True}, "bm score"), ("Café K", {}, "caf"), ("   !!!", {}, "")])
def test_tokens(spark, text, options, want):
    assert tokenize(text, TextOptions(**options)) == want.split()
    assert spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), TextOptions(**options)).alias("x")).first()["x"] == want.split()


@pytest.mark.parametrize("pair", "caresses caress,ponies poni,cats cat,running run,relational relat,a a,be be,seeing se,element elem,typing typ,type typ,ying y,bm25 bm,Running run".split(","))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want
    assert stem("42") == ""


@pytest.mark.parametrize("text,tree", [("a AND b OR c", Or(And(Term("a"), Term("b")), Term("c"))), ("a b", And(Term("a"), Term("b"))), ("NOT a b", And(Not(Term("a")), Term("b"))), ("a or (b or c)", Or(Term("a"), Or(Term("b"), Term("c")))), ("NOT NOT a", Not(Not(Term("a")))), ('"x y" foo-bar', And(Phrase(("x", "y")), Term("foo"))), ("(a)(b)", And(Term("a"), Term("b"))), ("and, x", And(Term("and"), Term("x")))])
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text,offset,message", [('  a "b', 4, "Unterminated"), ("  ", 0, "Empty query"), ("(a OR b", 0, "Unmatched"), ("a ((b", 3, "Unmatched"), ("x !!!", 2, "Empty term"), ('"  "', 0, "Empty phrase"), ("a AND", 5, "Unexpected end"), ("(", 1, "Unexpected end"), ("NOT", 3, "Unexpected end"), (")", 0, "Unexpected ')'"), ("()", 1, "Unexpected ')'"), ("AND a", 0, "Unexpected token"), ("a OR OR b", 5, "Unexpected token"), ("a )", 2, "Unexpected token after query")])
def test_parse_errors(text, offset, message):
    with pytest.raises(QueryError) as error:
        parse(text)
    assert error.value.offset == offset and message in error.value.message


def test_parser_survives_anything():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice('ab ()"!ANDORT\té') for _ in range(rng.randint(1, 20)))
        try:
            parse(text, TextOptions(rng.random() < 0.5, rng.random() < 0.5))
        except QueryError:
            pass
    assert len(query_terms(parse("(" * 5000 + "a" + ")" * 5000))) == 1


@pytest.mark.parametrize("query,want", [("cats AND milk", [0]), ("dogs OR honey", [1, 2]), ("cats AND NOT milk", [1]), ("(dogs OR honey) AND milk", [2]), ("unicorn", []), ("NOT unicorn", [0, 1, 2]), ('"cats love"', [0]), ('"love cats"', [])])
def test_boolean(spark, query, want):
    made = index(spark, TINY)
    assert ids(search.boolean(made, query)) == want
    for mode in setops.INTERSECT:
        assert ids(search.boolean_by_sets(made, query, mode)) == want


def test_phrases_and_stopwords(spark):
    assert ids(search.boolean(index(spark, ["the quick brown fox", "quick fox brown", "fox fox fox"]), '"fox fox"')) == [2]
    assert ids(search.boolean(index(spark, ["cats and milk"], remove_stopwords=True), '"cats milk"')) == [0]
    assert search.phrase_matches(index(spark, TINY), ["milk", "and"], 2) and not search.phrase_matches(index(spark, TINY), [], 0)


def test_ranking(spark):
    made = index(spark, FILES)
    got = hits(search.bm25(made, "cats milk"))
    assert [d for d, _ in got] == [0, 1] and got[0][1] == pytest.approx(2.48406, abs=1e-5) and got[1][1] == pytest.approx(0.961513, abs=1e-5)
    assert made.stats() == (5, 6.4) and made.df("cats") == 2 and made.tf("the", 3) == 2 and made.tf("zzz", 0) == 0
    assert [d for d, _ in hits(search.bm25(index(spark, TINY), "cats AND NOT cats"))] == [0, 1]
    assert hits(search.bm25(index(spark, TINY), "cats AND NOT cats", strict=True)) == []
    assert hits(search.bm25(index(spark, TINY), "NOT cats")) == [] and hits(search.bm25(made, "cats", k=0)) == []
    assert hits(search.rank_terms(made, [])) == []
    filtered = search.rank_terms(index(spark, ["cats milk", "cats dogs"]), ["cats"], candidates=spark.createDataFrame([(1,)], "doc_id long"))
    assert [d for d, _ in hits(filtered)] == [1]
    assert [d for d, _ in hits(search.bm25(index(spark, [f"shared term unique{i}" for i in range(10)]), "shared", 3))] == [2, 1, 0]


def test_top_k_is_what_a_bounded_heap_keeps(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(i, float(rng.randint(1, 4))) for i in range(30)]
        heap = []
        for d, s in rows:
            if len(heap) < 7:
                heap.append((s, d))
            elif s > min(heap)[0]:
                heap.remove(min(heap))
                heap.append((s, d))
        assert hits(search.top_k(spark.createDataFrame(rows, "doc_id long, score double"), 7)) == [(d, s) for s, d in sorted(heap, reverse=True)]


def test_index_plan_equals_scan_plan(spark):
    rng, words = random.Random(3), "a b c d e".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(40)]
    made, rows = index(spark, texts), spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "doc_id long, tokens array<string>")

    def tree(depth):
        kind = rng.randint(0, 4) if depth else rng.randint(0, 1)
        if kind == 0:
            return Term(rng.choice(words))
        if kind == 1:
            return Phrase(tuple(rng.choice(words) for _ in range(rng.randint(1, 3))))
        return Not(tree(depth - 1)) if kind == 2 else (And if kind == 3 else Or)(tree(depth - 1), tree(depth - 1))

    for _ in range(6):
        node = tree(3)
        assert ids(search.boolean(made, node)) == ids(rows.where(search.scan_predicate(F.col("tokens"), node))), node


def test_synonyms(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("# comment\nCat, kitten,feline\nsolo\ncat,tom\n")
    table = load_synonyms(str(path))
    assert table["cat"] == ["cat", "kitten", "feline", "tom"] and "solo" not in table and load_synonyms("/no/file") == {}
    assert load_synonyms(str(path), spark) == table and parse_synonyms([" #x,y"]) == {"#x": ["#x", "y"], "y": ["#x", "y"]}
    assert rewrite(parse('cat "cat dog"'), {"cat": ["cat", "kitten"]}) == And(Or(Term("cat"), Term("kitten")), Phrase(("cat", "dog")))
    assert ids(search.boolean(index(spark, ["a cute kitten plays", "dogs run"]), "cat", table)) == [0]


def test_codecs(spark):
    lists = [[0, 1, 127, 128, 255, 16384, 4294967295], [0, 1, 5, 100, 101, 1000], [2, 4, 8, 16, 32, 64, 128, 256], []]
    df = spark.createDataFrame([(x,) for x in lists], "v array<long>")
    got = df.select("v", codecs.compress(F.col("v")).alias("c"), codecs.decompress(codecs.compress(F.col("v"))).alias("back"), codecs.compressed_size(F.col("v")).alias("n")).collect()
    for r in got:
        assert r["back"] == r["v"] == codecs.unpack_numbers(bytes(r["c"])) and bytes(r["c"]) == codecs.pack_numbers(r["v"]) and r["n"] == len(r["c"])
    bad = spark.createDataFrame([(b"\x80",), (b"\xff" * 5 + b"\x01",)], "b binary").select(codecs.varbyte_decode(F.col("b")).alias("x")).collect()
    assert [r["x"] for r in bad] == [None, None]


def test_round_trip_holds_long_lists(spark, tmp_path):
    text = "the " * 3000 + "other " * 20_000 + "the rare " * 70
    spark.createDataFrame([(1, text), (2, "the the")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["term"], r["doc_id"]): (r["n_bytes"], r["positions"]) for r in queries.queries()["varbyte_round_trip"](spark, str(tmp_path)).collect()}
    assert len(got) == 4
    for (term, doc), (n, positions) in got.items():
        want = [i for i, w in enumerate({1: text, 2: "the the"}[doc].split()) if w == term]
        assert positions == " ".join(map(str, want)) and n == len(codecs.pack_numbers(want))


def test_files_and_stores(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "a").mkdir(parents=True)
    for name, text in {"a/b.txt": FILES[0], "a-b.txt": FILES[1], "_hidden.md": "", "skip.TXT": "no", ".txt": "no"}.items():
        (folder / name).write_text(text)
    rows = corpus.read_corpus(spark, str(folder)).orderBy("doc_id").collect()
    assert [r["path"].removeprefix(f"{folder}/") for r in rows] == ["_hidden.md", "a/b.txt", "a-b.txt"] and corpus.read_corpus(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "index")
    assert cli.main(["index", "build", str(folder), "-o", out], spark) == 0
    held = store.load_index(spark, out)
    assert held.stats() == (3, 10 / 3) and ids(search.boolean(held, "cats")) == [1, 2] and ids(search.boolean(held, "NOT cats")) == [0]
    plan = held.postings.where(F.col("term").isin("cats", "milk")).select("term", "doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and "positions" not in plan.split("ReadSchema")[-1]
    assert cli.main(["query", out, "cats milk", "--mode", "bm25"], spark) == 0 and cli.main(["query", out, "(", ""], spark) == 2
    assert cli.main(["query", out, "("], spark) == 1 and cli.main(["query", "/none", "a"], spark) == 1 and cli.main(["query", out, "a", "--mode", "x"], spark) == 2
    path = str(tmp_path / "index.bin")
    binary_index.export(held, path)
    back = binary_index.load(spark, path)
    assert ids(search.boolean(back, '"cats love"')) == [1] and back.stats()[0] == 3
    old = binary_index.encode([("p", 2)], [("a", [(0, [0, 1])])], 2.0, version=1)
    assert list(binary_index.decode(old)[1]) == [("a", [(0, [0, 1])])]
    for data in (b"", b"XXXX", old[:-1], b"MSEI\x09\0\0\0"):
        with pytest.raises(binary_index.FormatError):
            binary_index.decode(data)


def test_cli_prints(spark, tmp_path, capsys):
    folder, out = tmp_path / "docs", str(tmp_path / "index")
    corpus.write_synthetic(spark, str(folder), 5)
    for i, text in enumerate(FILES):
        (folder / f"doc{i + 1}.txt").write_text(text)
    assert cli.main(["index", "build", str(folder), "-o", out, "--stem"], spark) == 0
    assert capsys.readouterr().out == "Indexed 10 documents\n"
    ask = lambda *args: (cli.main(["query", out, *args], spark), capsys.readouterr())
    code, said = ask("cats AND NOT dogs", "--mmap", "--stem")
    assert code == 0 and said.out == f"{folder}/doc1.txt\n"
    code, said = ask("cats milk", "--mode", "bm25", "--topk", "1")
    assert code == 0 and said.out.endswith("doc1.txt\n") and said.out.count("\t") == 1 and float(said.out.split("\t")[0]) > 0
    for mode in ("two", "gallop", "skip"):
        assert ask("cats milk", "--intersect", mode)[1].out == f"{folder}/doc1.txt\n"
    assert ask("zzz")[1].out == "No results\n" and "Unterminated" in ask('"a')[1].err
    (tmp_path / "syn").write_text("zzz,cat\n")
    assert ask("zzz", "--synonyms", str(tmp_path / "syn"))[1].out == f"{folder}/doc1.txt\n{folder}/doc2.txt\n"
    assert cli.main(["query", "/none", "a"], spark) == 1 and capsys.readouterr().err.startswith("Failed to load index: /none")


def test_cli_bench_reports(spark, tmp_path, capsys):
    report = tmp_path / "report.md"
    assert cli.main(["bench", "--docs", "50", "--seed", "3", "--out", str(report)], spark) == 0
    text = report.read_text()
    assert capsys.readouterr().out == text and text.count("intersection p50, p95") == len(setops.INTERSECT) and "| documents | 50 |" in text
    resident = next(x for x in text.splitlines() if x.startswith("| resident bytes"))
    assert int(resident.split("|")[2]) > 1 << 20


def test_stream_adds_documents_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "index")
    for at in (0, 2):
        spark.createDataFrame([(at + i, t) for i, t in enumerate(TINY[at : at + 2])], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema("doc_id long, text string").parquet(source), out, str(tmp_path / "check")).awaitTermination()
    held = store.load_index(spark, out)
    assert ids(search.boolean(held, "milk")) == [0, 2] and held.stats()[0] == 3 and held.df("and") == 2


def test_batches_appear_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = lambda at: spark.createDataFrame([(at, "some milk"), (at, "other milk"), (at + 1, "cats")], "doc_id long, text string")
    add_batch(rows(0), 0, path, "s")
    commit = store._commit
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        add_batch(rows(10), 1, path, "s")
    monkeypatch.setattr(store, "_commit", commit)
    assert ids(store.load_index(spark, path).docs) == [0, 1]
    for _ in range(2):
        add_batch(rows(10), 1, path, "s")
    held = store.load_index(spark, path)
    assert ids(held.docs) == [0, 1, 10, 11] and held.stats() == (4, 1.5) and held.df("milk") == 2 and held.df("some") == 0
    add_batch(rows(10), 2, path, "s")
    store.compact(spark, path)
    assert ids(search.boolean(store.load_index(spark, path), "other")) == [0, 10]
    # an index that cannot be read stays as it is
    found = sorted((tmp_path / "index" / "manifests").glob("0*.json"))
    text = found[-1].read_text()
    found[-1].write_text("{")
    with pytest.raises(store.IndexError_):
        add_batch(rows(20), 3, path, "s")
    assert sorted((tmp_path / "index" / "manifests").glob("0*.json")) == found
    found[-1].write_text(text)
    assert store.load_index(spark, path).stats()[0] == 4
    with pytest.raises(FileExistsError):
        store._commit(spark, path, len(found) - 1, [], TextOptions(), {})


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbered_gives_each_id_once(spark, adaptive):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        rows = spark.range(0, 1_000_000, 1, 16).select(F.xxhash64("id").alias("name"))
        got = numbered(rows, "name").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("c")).first()
        assert tuple(got) == (1_000_000, 0, 999_999, 1_000_000)
        order = numbered(rows, "name").orderBy("doc_id").limit(1000).collect()
        assert [r["name"] for r in order] == sorted(r["name"] for r in order)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_wide_queries(spark):
    made = index(spark, [" ".join(f"w{j}" for j in range(i, i + 250)) for i in range(3)])
    query = " OR ".join(f"w{j}" for j in range(230)) + ' OR "w1 w2"'
    assert ids(search.boolean(made, query)) == [0, 1, 2] and ids(search.boolean(made, f"({query}) AND w0")) == [0]
    assert [d for d, _ in hits(search.bm25(made, query))][0] == 0


def test_skipping_reaches_the_scan(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 == 0, "a b").when(F.col("id") < 100, "c").otherwise("a").alias("text"))
    store.save_index(build_index(rows), str(tmp_path / "x"))
    held = store.load_index(spark, str(tmp_path / "x"))
    meet = setops.intersect_skip(held.lookup("c").select("doc_id"), held.lookup("a").select("doc_id"))
    assert meet.count() == 0
    meet = setops.intersect_skip(held.lookup("a").select("doc_id"), held.lookup("b").select("doc_id"))
    assert ids(meet) == list(range(0, 3000, 7)) and "GreaterThanOrEqual(doc_id,0)" in meet._jdf.queryExecution().toString()
    assert [(r["block"], r["n"]) for r in setops.skip_list(held.lookup("b"), 1000).orderBy("block").collect()] == [(0, 143), (1, 143), (2, 143)]
    assert cli.rss_bytes() > 1 << 20


def test_numbered_and_synthetic(spark):
    got = numbered(spark.createDataFrame([(c,) for c in "qwertyuiop"], "name string"), "name").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"]) for r in got] == list(enumerate(sorted("qwertyuiop")))
    rows = corpus.synthetic(spark, 50, 1).collect()
    assert all(20 <= len(r["text"].split()) <= 80 for r in rows) and cli.percentile([1, 2, 3, 4], 0.5) == 2.5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "events", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    mine, theirs = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key), sorted(want.select(*columns).fetchall(), key=key)
    assert len(mine) == len(theirs)
    assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))
