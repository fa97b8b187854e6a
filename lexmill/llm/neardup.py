"""Near-duplicates by BagMinHash signatures, bands and verified multiset overlap.

A document is the bag of its shingles of five words, lower-cased, with how often each occurs. Two documents are linked when
the weighted Jaccard similarity of their bags, the sum of the lesser counts over the sum of the greater, is at least 0.8.

Signatures. Every shingle has a Poisson process over weight and time. Its counts are discretised at the powers of
two: the weights 0-1, 1-2, 2-4, 4-8 ... have a process each, seeded by shingle and level, whose points fall in time
order onto the components of the signature; of the last level a document keeps the points whose weight coordinate lies
below its count, so that documents with different counts share all points that both may keep. A component's value
is its earliest point. Levels stop early: no point later than a time by which all components are filled is drawn.

Candidates. Equal bags are one class from the start, and a class is stood for by its least id. Bands of signature
components make buckets. A bucket is not expanded into pairs: its members are compared with one of them, links are
joined into components, the same with another member, and only members of a bucket that then belong to different
components are compared with each other. Bounds on the sizes of bags and on 252 signature bits and, for the last
comparison, an exact bound from sketches of the bags, all in the join's condition, go before the exact comparison. What may be lost: a pair at exactly 0.8 misses all 42 bands with
probability 3e-6, and the bound on bits, four and a half standard deviations below the mean, with probability 3e-6.

Null text is an empty text; documents without words have no shingles and are classes of their own. A document of one
to four words has one shingle of them all. Every row is a document of its own, whatever its id: rows that repeat an id may
belong to different classes, and null ids take part. Ids are of any type that has an order; a class is named by its least id, null if all
are null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import arrow_rows, cut, drop, fresh_names, give_back, matched, mix, shingles
from lexmill.llm.components import components

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 42, 6
SIZE = BANDS * ROWS
#: Signature bits that agree, of all, at four and a half standard deviations below the mean at similarity 0.8.
BITS = int(SIZE * 0.9 - 4.5 * (SIZE * 0.9 * 0.1) ** 0.5)
#: Bins of a sketch, the most that one of them counts, and the 64-bit numbers that this takes.
BINS, LEVELS = 512, 4
LONGS = BINS * LEVELS // 64
_U = np.uint64


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, key) with their counts, sorted by row."""
    if not len(keys):
        return keys, rows, np.zeros(0, np.int64)
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])
    at = np.flatnonzero(new)
    return keys[at], rows[at], np.diff(np.concatenate([at, [len(keys)]]))


def signatures(keys: np.ndarray, rows: np.ndarray, counts: np.ndarray, n: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Time of the earliest point of each component, and a hash of that point, for ``n`` rows."""
    best = np.full((n, size), np.inf)
    who = np.zeros((n, size), np.uint64)
    if not len(keys):
        return best, who
    # one process a level: its seed, width and the part of the width that counts
    seeds, owners, widths, parts = [], [], [], []
    level, low, width = 0, 0, 1
    have = np.arange(len(keys))
    while len(have):
        seeds.append(mix(keys[have] + _U(level * 0xA24BAED4963EE407 % 2**64)))
        owners.append(rows[have])
        widths.append(np.full(len(have), float(width)))
        parts.append(np.minimum(counts[have] - low, width) / width)
        low += width
        width = low
        level += 1
        have = have[counts[have] > low]
    seeds, owners, widths, parts = map(np.concatenate, (seeds, owners, widths, parts))
    total = np.bincount(rows, counts, n)
    # by this time about all components of a row are filled; the rows of which one is not go on to later ones
    limit = (np.log(size) + 3.0) / np.maximum(total, 1)
    start = np.zeros(len(seeds))
    step = np.zeros(len(seeds), np.uint64)
    wait = np.arange(len(seeds))
    first, hashes = best.reshape(-1), who.reshape(-1)
    done = np.bincount(rows, minlength=n) == 0
    while len(wait):
        live = wait
        later = []
        while len(live):
            x = mix(seeds[live] + (step[live] + _U(1)) * _U(0x9FB21C651E98DF25))
            time = start[live] - np.log(_uniform(x)) / (size * widths[live])
            late = time > limit[owners[live]]
            later.append(live[late])
            live, time, x = live[~late], time[~late], x[~late]
            y = mix(x ^ _U(0xD1B54A32D192ED03))
            z = mix(y)
            component = ((y >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
            kept = np.flatnonzero(_uniform(z) < parts[live])
            flat, when = owners[live[kept]] * size + component[kept], time[kept]
            np.minimum.at(first, flat, when)
            won = np.flatnonzero(first[flat] == when)
            hashes[flat[won]] = z[kept[won]]
            start[live], step[live] = time, step[live] + _U(1)
        done = done | (best.max(axis=1) <= limit)
        wait = np.concatenate(later) if later else np.zeros(0, np.int64)
        wait = wait[~done[owners[wait]]]
        limit = np.where(done, limit, 2 * limit)
    return best, who


def sketches(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Bins of a bag in unary: bit ``l`` of a bin is set where more than ``l`` shingles fall into it.

    Bits that differ between two sketches never outnumber the shingles that the bags do not share.
    """
    bins = (mix(keys ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.int64) % BINS
    counts = np.bincount(rows * BINS + bins, minlength=n * BINS).reshape(n, BINS)
    bits = np.concatenate([counts > level for level in range(LEVELS)], axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def _to_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Rows of a batch: hashing takes some thirty bytes for each byte of text, and pairs have two texts.
BATCH = 500
#: Parts that the rows of a large group of copies, or of a large class, are spread over.
TURNS = 16
_SIGNED = "size long, bag1 long, bag2 long, bands array<long>, sketch array<long>, s0 long, s1 long, s2 long, s3 long"


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, the digest of its text, the size of its bag, 128 bits that stand for the bag, its bands, and 252 bits of its signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            keys, rows = shingles(batch.column(1), WORDS)
            size = np.bincount(rows, minlength=n)
            bags = []
            for salt in (1, 2):
                sums = np.zeros(n, np.uint64)
                np.add.at(sums, rows, mix(keys * _U(2 * salt + 1) + _U(salt)))
                bags.append(mix(sums + size.astype(np.uint64)))
            _, who = signatures(*bag(keys, rows), n)
            sketch = sketches(keys, rows, n)
            bits = np.zeros((n, 256), np.uint8)
            bits[:, :SIZE] = (who >> _U(40)) & _U(1)
            words = np.packbits(bits, axis=1).view(np.uint64)
            value = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                value = mix(value + who[:, r::ROWS][:, :BANDS] * _U(2 * r + 1))
            value = mix(value + np.arange(BANDS, dtype=np.uint64)[None])
            offsets = pa.array(np.arange(0, BANDS * n + 1, BANDS, dtype=np.int32))
            bands = pa.ListArray.from_arrays(offsets, _to_signed(value.reshape(-1)))
            offsets = pa.array(np.arange(0, LONGS * n + 1, LONGS, dtype=np.int32))
            sketch = pa.ListArray.from_arrays(offsets, _to_signed(sketch.reshape(-1)))
            numbers = (pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), *map(_to_signed, bags), bands, sketch, *numbers], ["doc_id", "digest", *(x.split()[0] for x in _SIGNED.split(", "))])
        give_back()

    picked = _texts(docs, text_col, F.col(id_col).alias("doc_id")).select("doc_id", "words", "digest")
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, digest binary, {_SIGNED}")


def _texts(docs: DataFrame, text_col: str, *columns) -> DataFrame:
    """The lower-cased texts with a digest by which a text is found again."""
    words = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(*columns, words.alias("words")).withColumn("digest", F.unhex(F.md5("words")))


def overlaps(pairs: DataFrame) -> DataFrame:
    """``a, b, similarity`` from ``a, b, words_a, words_b``: the exact weighted Jaccard similarity of the bags."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            (ka, ra), (kb, rb) = (shingles(batch.column(i), WORDS) for i in (2, 3))
            keys, rows, side = np.concatenate([ka, kb]), np.concatenate([ra, rb]), np.concatenate([np.zeros(len(ka), bool), np.ones(len(kb), bool)])
            order = np.lexsort((keys, rows))
            keys, rows, side = keys[order], rows[order], side[order]
            at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
            if len(at):
                right = np.add.reduceat(side.astype(np.int64), at)
                both = np.diff(np.concatenate([at, [len(keys)]]))
                less = np.bincount(rows[at], np.minimum(right, both - right), n)
            else:
                less = np.zeros(n)
            whole = np.bincount(rows, minlength=n) - less
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(whole > 0, less / np.maximum(whole, 1), 0.0))], ["a", "b", "similarity"])
        give_back()

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def verify(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The links among candidate pairs ``a, b``. Only texts of candidates are moved."""
    named = lambda x: texts.select(F.col("rep").alias(f"id_{x}"), F.col("words").alias(f"words_{x}"))
    joined = pairs.join(named("a"), F.col("a") == F.col("id_a")).join(named("b"), F.col("b") == F.col("id_b"))
    return overlaps(joined.select("a", "b", "words_a", "words_b")).where(F.col("similarity") >= similar).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, class_size`` for every row of ``docs``; the class id is the least id of the class."""
    return _classes(docs, id_col, text_col, similar).select("doc_id", "class_id", "class_size")


def _classes(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    """``doc_id, digest, first, class_id, class_size``: ``first`` tells the one row of its class that has the least id."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _classified(docs, id_col, text_col, similar)


def _classified(docs: DataFrame, id_col: str, text_col: str, similar: float) -> DataFrame:
    signed = cut(sign(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signed")
    key = ["bag1", "bag2", "size"]
    spread = F.pmod("row", F.lit(TURNS)).cast("int")
    # equal bags are one class from the start, stood for by one row; a bag that many rows have is spread over several tasks
    bags = signed.where("size > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    bags = bags.select(*(F.col(c).alias(f"r_{c}") for c in key), "rep", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("t"))
    members = signed.select("row", "doc_id", "digest", *key).join(bags, [*(F.col(c) == F.col(f"r_{c}") for c in key), spread == F.col("t")], "left")
    members = cut(members.select("row", "doc_id", "digest", "size", F.coalesce("rep", "row").alias("rep")), "members")
    reps = matched(signed.where("size > 0"), members.where("row <> rep").select(F.col("row").alias("copy")), F.col("row") == F.col("copy"), "left_anti")
    # bands alone are dealt first; what the join conditions need follows for the rows of shared buckets
    rows = reps.select(F.col("row").alias("rep"), F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("full"))
    slim = rows.join(shared, F.col("band") == F.col("full"), "left_semi")
    buckets = cut(slim.join(reps.select(F.col("row").alias("own"), "digest", "size", "s0", "s1", "s2", "s3"), F.col("rep") == F.col("own")).drop("own"), "buckets")
    wanted = cut(buckets.select("rep", F.col("digest").alias("wanted")).distinct(), "wanted")
    buckets = buckets.drop("digest")
    texts = matched(_texts(docs, text_col), wanted, F.col("digest") == F.col("wanted"), "inner")
    texts = cut(texts.groupBy("rep").agg(F.first("words").alias("words")), "texts")
    near = lambda a, b: (F.least(a, b) >= F.greatest(a, b) * similar)
    agree = lambda x, y: sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(4)), F.lit(0)) <= SIZE - BITS
    links, labels, tried = [], None, []
    for turn in (0, 1):
        held = buckets
        if labels is not None:
            held = _labelled(buckets, labels)
            open_ = held.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("band").alias("full"))
            held = held.join(open_, F.col("band") == F.col("full"), "left_semi")
        order = F.col("rep") if turn == 0 else F.xxhash64(F.col("rep"), F.lit(turn))
        chosen = held.groupBy("band").agg(F.min(F.struct(order.alias("o"), F.col("rep"), F.col("size"), *(F.col(f"s{i}") for i in range(4)), *([F.col("label")] if turn else []))).alias("p")).select(F.col("band").alias("p_band"), "p.*")
        pairs = held.alias("x").join(chosen.alias("y"), (F.col("x.band") == F.col("y.p_band")) & (F.col("x.rep") != F.col("y.rep")) & near(F.col("x.size"), F.col("y.size")) & agree("x", "y") & ((F.col("x.label") != F.col("y.label")) if turn else F.lit(True)))
        pairs = cut(pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "pairs")
        tried.append(pairs)
        links.append(cut(verify(pairs, texts, similar), "links"))
        labels = components(_all(links))
    held = _labelled(buckets, labels)
    open_ = held.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("band").alias("full"))
    held = held.join(open_, F.col("band") == F.col("full"), "left_semi")
    held = cut(held.join(reps.select(F.col("row").alias("own"), "sketch", "bands"), F.col("rep") == F.col("own")).drop("own"), "open")
    # shingles not shared are at most this share of all where the similarity is reached; the sketches bound them from below
    apart = sum((F.bit_count(F.get("x.sketch", F.lit(i)).bitwiseXOR(F.get("y.sketch", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    # the tolerance keeps pairs at exactly the threshold, where both sides are equal but for rounding
    both = F.col("x.size") + F.col("y.size")
    close = apart * (1 + similar) <= both * (1 - similar + 1e-9)
    # a pair counts in the first bucket that both are in, so it is made once
    band = lambda x, i: F.get(f"{x}.bands", F.lit(i))
    met = F.coalesce(*(F.when(band("x", i) == band("y", i), band("x", i)) for i in range(BANDS)))
    pairs = held.alias("x").join(held.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & near(F.col("x.size"), F.col("y.size")) & agree("x", "y") & close & (met == F.col("x.band")))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(_all(tried), ["a", "b"], "left_anti")
    links.append(cut(verify(cut(pairs, "pairs"), texts, similar), "links"))
    labels = components(_all(links))
    # classes of one bag alone have no label; the rows of a class are spread by their turn
    out = cut(members.join(labels, F.col("rep") == F.col("node"), "left").select("row", "doc_id", "digest", F.coalesce("label", "rep").alias("label")), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")
    sizes = out.groupBy("label").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    sizes = sizes.select(F.col("label").alias("c"), "least", "class_size", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1))).alias("t"))
    out = out.join(sizes, (F.col("label") == F.col("c")) & (spread == F.col("t")), "left")
    alone = F.col("least").isNull()
    out = out.select("doc_id", "digest", (alone | (F.col("row") == F.col("least.row"))).alias("first"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    out = cut(out, "classes")
    drop(signed, members, buckets, wanted, texts, *tried, *links)
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with one row of each class, the one with the least id.

    Rows are told by id and text; of rows that agree in both, one stays if that is the row to keep.
    """
    name = fresh_names(docs, "id", "digest", "gone")
    found = _classes(docs, id_col, text_col, similar)
    said = found.groupBy("doc_id", "digest").agg(F.max("first").alias("stays"), F.count(F.lit(1)).alias("n"))
    digest = F.unhex(F.md5(F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.withColumn(name["digest"], digest)
    named = said.select(F.col("doc_id").alias(name["id"]), F.col("digest").alias(name["gone"]), "stays", "n")
    same = docs[id_col].eqNullSafe(F.col(name["id"])) & (F.col(name["digest"]) == F.col(name["gone"]))
    # rows that agree in id and text with another, of which one stays, are taken apart from the others
    again = named.where("stays and n > 1").drop("stays", "n")
    out = matched(rows, named.where("not stays or n > 1").drop("stays", "n"), same, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(matched(rows, again, same, "left_semi").dropDuplicates([id_col, name["digest"]]))
    return out.select(*docs.columns)
