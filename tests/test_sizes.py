"""Steps whose memory and time have to follow the input: they work on parts of a batch, and keep their results."""

import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions import batches, codecs
from lexmill.functions.text import TextOptions, tokenize
from lexmill.operators.index import build_index, postings_of
from lexmill.plans import queries


def test_postings_are_made_of_parts_of_a_batch():
    class Docs:
        def mapInArrow(self, run, kind):
            return run

    texts = [f"w{i} the {'of the ' * 3000} w{i % 7}" for i in range(400)] + [None, "", "the " * 900_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for options in (TextOptions(), TextOptions(remove_stopwords=True), TextOptions(stem=True)):
        parts = list(postings_of(Docs(), options)(iter([batch, batch.slice(0, 0)])))
        assert len(parts) > 3 and max(sum(p.column(2).to_pylist()) for p in parts) <= max(900_000, batches.TEXT_BYTES)
        got = {(t, d): (n, x) for p in parts for t, d, n, x in zip(*(c.to_pylist() for c in p.columns), strict=True)}
        assert sum(p.num_rows for p in parts) == len(got)
        for doc in (0, 17, 399, 400, 401, 402):
            words = tokenize(texts[doc], options)
            want = {}
            for place, word in enumerate(words):
                want.setdefault(word, []).append(place)
            assert {t: x for (t, d), x in got.items() if d == doc} == {t: (len(x), x) for t, x in want.items()}


def test_stemmed_lengths(spark):
    texts = ["running cats 42", None, "", "licensed things and 7 of the", "cats " * 500_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = build_index(rows, TextOptions(stem=True)).docs
    assert "regexp" not in made._jdf.queryExecution().toString()  # words are split and stemmed in one step
    assert {r["doc_id"]: r["length"] for r in made.collect()} == {i: len(tokenize(t, TextOptions(stem=True))) for i, t in enumerate(texts)}


def test_codes_of_long_lists_and_nulls(spark):
    lists = [list(range(i, 100_000 * (i + 1), i + 1)) for i in range(5)] + [[], [2**32 - 1, 5, 5], [300, 1]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, v array<long>").coalesce(1)
    assert sum(map(len, lists)) > batches.VALUES
    data = codecs.compress(F.col("v"))
    got = rows.select("i", data.alias("c"), codecs.decompress(data).alias("back"))
    assert "unhex" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        assert bytes(r["c"]) == codecs.pack_numbers(lists[r["i"]]) and r["back"] == [x % 2**32 for x in lists[r["i"]]]
    odd = [None, [None], [3, None, 9, 10], [-1, 3], [1 << 36, (1 << 40) + 3]]
    rows = spark.createDataFrame([(x,) for x in odd], "v array<long>").coalesce(1)
    got = rows.select(codecs.varbyte_encode(F.col("v")).alias("e"), codecs.compress(F.col("v")).alias("c")).collect()
    assert [bytes(r["e"]).hex() for r in got] == ["", "", "03090a", "7f03", "80808080808380808080"]
    assert [bytes(r["c"]).hex() for r in got][:4] == ["", "", "0301", "ffffffff0f04"]


def test_positions_are_sized_before_terms_meet(spark, sf_dir):
    plan = queries.compressed_index_size(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Window [" in line)
    assert " AS size" in plan[at + 1], plan
