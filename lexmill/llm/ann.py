"""Nearest neighbours by learned partitions.

A bounded sample of the vectors gives a graph of nearest neighbours; the graph is cut into parts of nearly equal size
with few edges between them; a small softmax classifier learns to tell the parts of a vector's neighbours. Every row is then indexed
under its most probable part. A query visits its most probable parts, as many as a second sample needed for the
recall that is asked, and is ranked against the vectors there by exact distances.

The fit uses at most ``SAMPLE`` vectors and the calibration ``CHECKS`` queries, both taken in hash order: these are its
parameters. Parts are about as many as the root of the rows, as long as each has ``LEAST`` vectors of the sample. Indexing and search see every row. A part is divided into chunks of at most ``CHUNK`` rows by a hash of the id
and the queries into blocks, so neither a part that holds most rows nor many queries land in one task. No pairs leave
a task but the nearest of each query and chunk.

Vectors that are null, zero, of another length than most of the sample, or that hold null or non-finite components take
no part, as queries or as candidates. Ties go to the smaller id. Rows that repeat an id are candidates of their own; a
query's own id is never its candidate. With fewer candidates than asked, all are returned: so few vectors make one part. Columns
other than the two named are ignored. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import sample_of

SAMPLE = 6000
CHECKS = 300
#: Vectors of the sample that a part has at least; parts are as many as that allows, up to about the root of all rows.
LEAST = 32
GRAPH = 10
RECALL = 0.95
CHUNK = 4096
BLOCK = 16384


def valid(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """Indices of the nearest ``k`` of each row, in blocks."""
    k = min(k, len(x) - 1)
    squares, out = (x * x).sum(1), np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = squares[None] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.05, passes: int = 8, seed: int = 3) -> np.ndarray:
    """Halves along leading directions first, then moves nodes to where most neighbours are while sizes allow."""
    part = np.zeros(len(x), np.int64)
    rng = np.random.default_rng(seed)
    width = 1
    while width < parts:
        for p in range(width):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                y, v = x[own] - x[own].mean(0), rng.normal(size=x.shape[1])
                for _ in range(12):
                    v = y.T @ (y @ v)
                    v /= np.linalg.norm(v) or 1.0
                order = np.argsort(y @ v, kind="stable")
                part[own[order[len(own) // 2 :]]] += width
        width *= 2
    both = [[] for _ in range(len(x))]
    for i, near in enumerate(graph.tolist()):
        both[i] += near
        for j in near:
            both[j].append(i)
    both = [np.array(b, np.int64) for b in both]
    sizes, most, least = np.bincount(part, minlength=width), slack * len(x) / width, len(x) / width / slack
    for _ in range(passes):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(part[both[i]], minlength=width)
            own = part[i]
            if sizes[own] - 1 < least:
                continue
            votes = np.where(sizes + 1 <= most, votes, -1)
            to = int(votes.argmax())
            if to != own and votes[to] > votes[own]:
                part[i], moved = to, moved + 1
                sizes[own] -= 1
                sizes[to] += 1
        if not moved:
            break
    return part


@dataclass
class Index:
    """A softmax classifier over parts, with one hidden layer, and how many parts a query visits."""

    center: np.ndarray
    scale: float
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.second_bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, hidden: int = 64, epochs: int = 30, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    center, scale = sample.mean(0), float(sample.std()) or 1.0
    graph = neighbour_graph(sample)
    part = balanced_parts(sample, graph, parts)
    x = (sample - center) / scale
    # what the classifier learns of a vector: the parts that its neighbours are in, and its own
    parts = int(part.max()) + 1
    share = np.zeros((len(x), parts))
    for near in (np.arange(len(x))[:, None], graph):
        np.add.at(share, (np.arange(len(x))[:, None], part[near]), 1.0)
    share /= share.sum(1, keepdims=True)
    weights = [rng.normal(0, 1 / np.sqrt(dim), (dim, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    moments, step = [[np.zeros_like(w), np.zeros_like(w)] for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            h = np.tanh(x[rows] @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= share[rows]
            p /= len(rows)
            back = (p @ weights[2].T) * (1 - h * h)
            step += 1
            for w, g, (m, v) in zip(weights, (x[rows].T @ back, back.sum(0), h.T @ p, p.sum(0)), moments, strict=True):
                g = g + 1e-4 * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    index = Index(center, scale, *weights, probes=parts)
    # how many parts hold the neighbours of sampled queries, placed as the index places them
    placed = index.logits(sample).argmax(1)
    checks = rng.permutation(len(sample))[:CHECKS]
    ranks = np.argsort(np.argsort(-index.logits(sample[checks]), axis=1), axis=1)
    reach = ranks[np.arange(len(checks))[:, None], placed[graph[checks]]]
    for probes in range(1, parts + 1):
        if (reach < probes).mean() >= recall:
            index.probes = probes
            break
    return index


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, **how) -> Index | None:
    """Fits on at most ``sample`` valid vectors, taken in hash order."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    got = sample_of(rows, "vec_id", sample, 17).toPandas()
    if len(got) < 2:
        return None
    lengths = got["vector"].map(len)
    x = np.stack(got["vector"][lengths == lengths.mode()[0]].to_numpy()).astype(np.float64)
    if len(x) < 2:
        return None
    parts = min(int(rows.count() ** 0.5), len(x) // LEAST)
    return fit(x, parts=1 << max(0, parts.bit_length() - 1) if len(x) >= 4 * LEAST else 1, **how)


def nearest(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the nearest ``k`` rows with another id: query numbers, row numbers, exact distances.

    A matrix product picks all rows that its rounding error leaves in question; their distances are then taken from
    differences of the vectors, in double precision.
    """
    rough = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
    error = 1e-12 * ((q * q).sum(1)[:, None] + (x * x).sum(1).max())
    rough[q_ids[:, None] == ids[None]] = np.inf
    k = min(k, len(x))
    bound = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
    qi, xi = np.nonzero((rough <= bound + error) & np.isfinite(rough))
    exact = np.empty(len(qi))
    for at in range(0, len(qi), 8192):
        d = q[qi[at : at + 8192]] - x[xi[at : at + 8192]]
        exact[at : at + 8192] = np.sqrt((d * d).sum(1))
    order = np.lexsort((xi, ids[xi], exact, qi))
    qi, xi, exact = qi[order], xi[order], exact[order]
    first = np.searchsorted(qi, qi)
    keep = np.arange(len(qi)) - first < k
    return qi[keep], xi[keep], exact[keep]


def search(vectors: DataFrame, queries: DataFrame, index: Index | None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` found of every query."""
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(index)
    dim = len(index.center)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")) & (F.size("vector") == dim))

    def route(probes: int | None):
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in it:
                if len(rows):
                    z = shared.value.logits(np.stack(rows["vector"].to_numpy()))
                    rows["parts"] = z.argmax(1) if probes is None else list(np.argsort(-z, axis=1, kind="stable")[:, :probes].astype(np.int32))
                    yield rows

        return run

    rows = pick(vectors).mapInPandas(route(None), "vec_id long, vector array<double>, parts int").withColumnRenamed("parts", "part")
    # parts are few: the numbers of their chunks of rows and of their blocks of queries fit small maps
    number = lambda df, most: {r["part"]: -(-r["count"] // most) for r in df.groupBy("part").count().collect()}
    asked = pick(queries).mapInPandas(route(index.probes), "vec_id long, vector array<double>, parts array<int>").withColumn("part", F.explode("parts")).drop("parts")
    counts, blocks = number(rows, CHUNK), number(asked, BLOCK)
    both = sorted(counts.keys() & blocks.keys())
    if not both:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda numbers: F.element_at(F.create_map(*(F.lit(x) for part in both for x in (part, numbers[part]))), F.col("part"))
    # a part's rows are copied once for each block of the queries that visit it, its queries once for each chunk
    every = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers).cast("int") - 1))
    rows = rows.where(F.col("part").isin(both)).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of(counts)).cast("int")).withColumn("block", every(blocks))
    asked = asked.where(F.col("part").isin(both)).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of(blocks)).cast("int")).withColumn("chunk", every(counts))

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, x = left["vec_id"].to_numpy(), np.stack(left["vector"].to_numpy())
            for at in range(0, len(right), 256):
                some = right.iloc[at : at + 256]
                qi, xi, d = nearest(ids, x, some["vec_id"].to_numpy(), np.stack(some["vector"].to_numpy()), k)
                out.append(pd.DataFrame({"query_id": some["vec_id"].to_numpy()[qi], "vec_id": ids[xi], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = rows.groupBy("part", "chunk", "block").cogroup(asked.groupBy("part", "chunk", "block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
