"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained together in numpy.

A word is the mean of the embeddings of its character n-grams, with marks for its begin and end, and of the word as a
whole; the embeddings sit in a hashed table. A document is the mean of its words, and a linear softmax over two classes
follows; a long text would bury a few words in one average, so the words that stand for it are the twentieth part of the
highest margins. The last step makes a probability of three such means: of those words, of the highest few, and of the highest run of
neighbouring words. It is fitted on documents that the margins it sees were not fitted on.

The fit, in one task, uses a sample of at most ``sample`` labelled rows and a bounded number of bytes, half of each class at most, taken in hash order from the
rows allowed for learning; texts above a sixteenth of these bytes are left out of the sample, not of the scores. Scoring reads every row and
whole texts. Language, source, id and label are not inputs of a score. As the model is linear after the averages, workers hold one number an n-gram.

Null and empty texts, and texts without words, have features of zero, those of a text without evidence. Repeated rows are scored alike. With no labelled rows, or one class only, all scores are
the share of toxic labels, 0 without any. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import arrow_rows, doc_crc, give_back, sample_of

BUCKETS = 1 << 18
DIM = 6
GRAMS = (3, 4, 5)
#: One word in so many of a document stands for it, those of the highest margins, but at least so many; and the words of a run.
PART, FEWEST, RUN = 20, 3, 8
#: Labelled rows and bytes of text that the fit takes at most; parts that the last step is fitted in.
SAMPLE, BYTES, FOLDS = 4000, 64 << 20, 2
RARE = 3
DECAY = 1e-3
THRESHOLD = 0.3
CACHE = 300_000
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-*@$!0-9]?[^\W\d_]+)*").findall
_P = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words one after another, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(marked)), lengths)
    left = ends[owner] - np.arange(len(codes))
    found, whose = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        have = np.flatnonzero(left >= n)
        value[have] = (value[have] + codes[have + n - 1] + np.uint64(n)) * _P
        value[have] ^= value[have] >> np.uint64(29)
        if n in GRAMS:
            found.append(value[have] * np.uint64(2 * n + 1))
            whose.append(owner[have])
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max(initial=1)), _P)]))
    place = np.arange(len(codes)) - starts[owner] if len(codes) else np.zeros(0, np.int64)
    whole = np.add.reduceat(codes * powers[place], starts) if len(codes) else np.zeros(0, np.uint64)
    found.append(whole * np.uint64(3))
    whose.append(np.arange(len(marked)))
    found, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    found = found[order]
    found ^= found >> np.uint64(32)
    return ((found * _P) >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS, np.bincount(whose, minlength=len(marked))


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


@dataclass
class Model:
    """``weight`` is the margin of each n-gram; ``mix`` and ``shift`` make a logit of a document's features."""

    weight: np.ndarray
    mix: np.ndarray
    shift: float
    constant: float | None = None

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        return 1 / (1 + np.exp(-np.clip(features @ self.mix + self.shift, -60, 60)))


def told(n: np.ndarray) -> np.ndarray:
    """How many words of a document of ``n`` words stand for it."""
    return np.minimum(np.maximum(-(-n // PART), FEWEST), n)


class Scorer:
    """Features and probabilities of texts; margins of words met so far are remembered."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """The mean margin of the words that stand for each text, that of its ``FEWEST`` highest words, and that of its highest run
        of ``RUN`` words; zeros without words."""
        split, known = [words_of(t) for t in texts], self.known
        if len(known) > CACHE:
            known.clear()
        fresh = list({w for words in split for w in words if w not in known})
        for at in range(0, len(fresh), 10_000):
            some = fresh[at : at + 10_000]
            ids, counts = grams(some)
            sums = np.add.reduceat(self.model.weight[ids], np.concatenate([[0], np.cumsum(counts)[:-1]]))
            known.update(zip(some, (sums / counts).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for i, words in enumerate(split):
            n = len(words)
            if n:
                v = np.fromiter(map(known.__getitem__, words), np.float64, n)
                sums = np.concatenate([[0.0], np.cumsum(v)])
                run = min(RUN, n)
                k, few = int(told(np.int64(n))), min(FEWEST, n)
                top = np.partition(v, n - k)[n - k :]
                out[i] = top.mean(), (top if k == few else np.partition(top, k - few)[k - few :]).mean(), (sums[run:] - sums[:-run]).max() / run
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return self.model.probability(self.features(texts))


def margins(texts: list[str | None], labels: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray | None:
    """The margin of each n-gram: Adam on all documents at once; embeddings and softmax weights move together.

    N-grams of fewer than ``RARE`` documents keep a zero vector. The others start from small random vectors
    along whose first two directions lie the logarithms of how much likelier toxic documents hold them.
    """
    vocabulary: dict[str, int] = {}
    split = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    if not vocabulary:
        return None
    distinct = list(vocabulary)
    blocks = [grams(distinct[at : at + 10_000]) for at in range(0, len(distinct), 10_000)]
    gram, per_word = np.concatenate([g.astype(np.int32) for g, _ in blocks]), np.concatenate([n for _, n in blocks])
    del blocks, distinct, vocabulary
    owner = np.repeat(np.arange(len(per_word), dtype=np.int32), per_word)
    # documents of either class that hold an n-gram
    first = np.concatenate([[0], np.cumsum(per_word)])
    seen = np.zeros((2, BUCKETS))
    for ids, y in zip(split, labels, strict=True):
        ids = np.unique(ids)
        if len(ids):
            at = np.repeat(first[ids], per_word[ids]) + np.arange(per_word[ids].sum()) - np.repeat(np.cumsum(per_word[ids]) - per_word[ids], per_word[ids])
            seen[y, np.unique(gram[at])] += 1
    n = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds[seen.sum(0) < RARE] = 0
    keep = np.flatnonzero(seen.sum(0)[gram] >= RARE)
    used = np.flatnonzero(np.bincount(gram[keep], minlength=BUCKETS))
    gram, owner = np.searchsorted(used, gram[keep]).astype(np.int32), owner[keep]
    del keep
    flat = np.concatenate(split).astype(np.int32)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    docs = np.repeat(np.arange(len(split), dtype=np.int32), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    stand = told(sizes)
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.05, (len(used), DIM)), rng.normal(0, 0.05, (DIM, 2)), np.zeros(2)
    emb[:, 0] += odds[used]
    emb[:, 1] -= odds[used]
    soft[0, 1] += 1
    soft[1, 0] += 1
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft, bias)]
    have = sizes > 0
    weight = np.where(have, np.where(labels == 1, 1 / max(int(have[labels == 1].sum()), 1), 1 / max(int(have[labels == 0].sum()), 1)), 0)
    word = np.zeros((len(per_word), DIM))
    for step in range(1, rounds + 1):
        for k in range(DIM):
            word[:, k] = np.bincount(owner, emb[gram, k], len(per_word)) / per_word
        # a document is the mean of its words of the highest margins
        order = np.lexsort((-(word @ (soft[:, 1] - soft[:, 0]))[flat], docs))
        hot = order[np.arange(len(flat)) - starts < stand[docs]]
        whose, what = docs[hot], flat[hot]
        vectors = np.stack([np.bincount(whose, word[what, k], len(split)) for k in range(DIM)], 1) / np.maximum(stand, 1)[:, None]
        logits = vectors @ soft + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(split)), labels] -= 1
        grad = p * weight[:, None]
        back = grad @ soft.T / np.maximum(stand, 1)[:, None]
        g_emb = np.empty_like(emb)
        for k in range(DIM):
            g_word = np.bincount(what, back[whose, k], len(per_word)) / per_word
            g_emb[:, k] = np.bincount(gram, g_word[owner], len(used))
        g_emb += DECAY * (emb - emb.mean(0)) / len(used)
        for value, g, (m, v) in zip((emb, soft, bias), (g_emb, vectors.T @ grad, grad.sum(0)), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = emb @ (soft[:, 1] - soft[:, 0])
    return table


def _features(table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    scorer = Scorer(Model(table, np.zeros(3), 0.0))
    return np.concatenate([scorer.features(texts[at : at + 200]) for at in range(0, len(texts), 200)])


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic curve over features, of which each counts by its spread."""
    mid, spread = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mid) / spread, np.ones((len(x), 1))], 1)
    w, keep = np.zeros(z.shape[1]), decay * np.eye(z.shape[1])
    keep[-1, -1] = 1e-3
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + keep, z.T @ (y - q) - keep @ w)
    return w[:-1] / spread, float(w[-1] - (w[:-1] * mid / spread).sum())


def fit(texts: list[str | None], labels: list[int], **how) -> Model:
    """The margins from all rows; how features become a probability is fitted where the margins were not, in ``FOLDS`` parts."""
    y = np.asarray(labels, np.int64)
    constant = lambda: Model(np.zeros(BUCKETS, np.float32), np.zeros(3), 0.0, float(y.mean()) if len(y) else 0.0)
    if not len(y) or y.min() == y.max():
        return constant()
    table = margins(texts, y, **how)
    if table is None:
        return constant()
    turn, x = np.arange(len(y)) % FOLDS, np.zeros((len(y), 3))
    for fold in range(FOLDS):
        rest, own = np.flatnonzero(turn != fold), np.flatnonzero(turn == fold)
        other = margins([texts[i] for i in rest], y[rest], **how) if len(set(y[rest].tolist())) == 2 else None
        if len(own):
            x[own] = _features(table if other is None else other, [texts[i] for i in own])
    return Model(table, *logistic(x, y))


def train(docs: DataFrame, labels: DataFrame, allowed=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Fits, in one task, on at most ``sample`` labelled rows of ``most`` bytes of text; ``allowed`` is a condition on the id.

    Half of each class at most, in hash order of the ids. Of rows that repeat an id the one with the least text counts.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if allowed is not None:
        chosen = chosen.where(allowed)
    chosen = chosen.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    some = [sample_of(chosen.where(F.col("label") == y), "label_id", sample // 2, 11) for y in (0, 1)]
    picked = some[0].unionByName(some[1])
    # few ids are broadcast; a long text is one of few as well, so that the bytes are bounded before texts move
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    rows = rows.join(F.broadcast(picked), F.col("key") == F.col("label_id")).where(F.octet_length("words") <= most // 16)
    rows = rows.groupBy("key", "label").agg(F.min("words").alias("words"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.col("key").cast("string"), F.lit(12)), "key")
    rows = rows.withColumn("so_far", F.sum(F.octet_length("words")).over(order)).where(F.col("so_far") <= most // 2)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((key, text, y) for batch in it for key, text, y in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
        model = fit([t for _, t, _ in found], [y for _, _, y in found])
        constant = model.constant if model.constant is not None else -1.0
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()]), pa.array([[*model.mix.tolist(), model.shift, constant]])], ["weight", "numbers"])
        del found, model
        give_back()

    key = F.xxhash64(F.col("key").cast("string")).alias("key")
    with arrow_rows(docs.sparkSession, 500):
        got = rows.select(key, "words", "label").repartition(1).mapInArrow(run, "weight binary, numbers array<double>").first()
    if got is None:  # no labelled rows
        return fit([], [])
    *mix, shift, constant = got["numbers"]
    return Model(np.frombuffer(got["weight"], np.float32), np.array(mix), shift, constant if constant >= 0 else None)


def _scored(docs: DataFrame, model: Model, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """``doc_id, score`` and the columns in ``keep`` as ``kept_0, kept_1 ...``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("words"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name != "words")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names = [n for n in part.schema.names if n != "words"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], [*names, "score"])
        del scorer
        give_back()

    return picked.mapInArrow(run, f"{schema}, score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, over whole texts."""
    return _scored(docs, model, id_col, text_col, ())


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with its columns."""
    kept = _scored(docs, model, id_col, text_col, tuple(docs.columns)).where(F.col("score") < threshold)
    return kept.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)))


def held_out(id_col: str = "doc_id"):
    """Rows of which no label is learnt."""
    return F.coalesce(doc_crc(id_col) % 4 == 2, F.lit(False))
