"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan of inverted lists.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with the largest norm M (0 for queries), so that the
largest inner product is the least distance, and are rotated by a random orthogonal matrix. Lists are the
cells of k-means centroids, fitted on a bounded sample (``SAMPLE`` vectors, by hash); every vector is
indexed. Each query probes its nearest lists. In a list the rotated coordinates are met in column blocks:
after each block a hypothesis test compares the partial distance, scaled up to all coordinates, with the
query's threshold and abandons candidates that would be too far but for a deviation of ``SURE``
standard errors. The threshold is the distance of the k-th best so far and begins with the k-th best
in the sample, which is a bound for all rows; the sample's best are candidates too, so a query whose
lists are poor still gets k rows. Survivors are scored on the original vectors in double precision.

Copies of a vector are one candidate with its smallest ids. Lists are cut into blocks of about
``BLOCK`` vectors by the key's hash, so a crowded list is spread over tasks.

Defined results: see ``vectors.valid`` for rows that take no part; ties go to the smaller id; a row that
repeats an id and a vector is one candidate; with fewer candidates than k a query has fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import vectors as V
from plumbline.llm.common import stored

SAMPLE = 4096
BLOCK = 2048
CHUNK = 512
SURE = 2.1
SEED = 7
COLUMNS = (8, 16, 32)
PROBED = 0.65
LEAST_PROBED = 8


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, n: int, turns: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(turns):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, 1)
        many = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[many > 0] = total[many > 0] / many[many > 0, None]
    return c


class Index:
    """What every task needs, of bounded size: rotation, centroids and the rotated sample."""

    def __init__(self, sample: np.ndarray, ids: list[list[int]], norm: float, lists: int):
        self.original, self.ids, self.d = sample, ids, sample.shape[1]
        self.norm = norm
        self.turn = rotation(self.d + 1)
        self.sample = self.rotated(sample)
        self.centroids = kmeans(self.sample, min(lists, len(sample)))

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate([x, more[:, None]], 1) @ self.turn

    def nearness(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return (c * c).sum(1) - 2 * x @ c.T


def scan(x: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, rows) of the ``k`` nearest of ``x`` to each query, inf where fewer are found."""
    d = x.shape[1]
    cuts = [0, *[c for c in COLUMNS if c < d], d]
    dist, near = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
    limit = limit.copy()
    qn = [(q[:, a:b] ** 2).sum(1) for a, b in zip(cuts, cuts[1:])]
    for s in range(0, len(x), CHUNK):
        xs = x[s : s + CHUNK]
        part = qn[0][:, None] + (xs[:, : cuts[1]] ** 2).sum(1) - 2 * q[:, : cuts[1]] @ xs[:, : cuts[1]].T
        qi, xi = (np.repeat(np.arange(len(q)), len(xs)), np.tile(np.arange(len(xs)), len(q)))
        p = part.ravel()
        for a, b in zip(cuts[1:], cuts[2:]):
            keep = p * (d / a) <= limit[qi] * (1 + SURE / np.sqrt(a)) ** 2
            qi, xi, p = qi[keep], xi[keep], p[keep]
            diff = q[qi, a:b] - xs[xi, a:b]
            p = p + np.einsum("ij,ij->i", diff, diff)
        keep = p <= limit[qi] * (1 + 1e-9) + 1e-12
        qi, xi, p = qi[keep], xi[keep], p[keep]
        if not len(qi):
            continue
        hit = np.unique(qi)
        place = np.full(len(q), -1)
        place[hit] = np.arange(len(hit))
        dense = np.full((len(hit), len(xs)), np.inf)
        dense[place[qi], xi] = p
        both = np.concatenate([dist[hit], dense], 1)
        rows = np.concatenate([near[hit], np.broadcast_to(np.arange(s, s + len(xs)), dense.shape)], 1)
        at = np.argpartition(both, k - 1, 1)[:, :k]
        dist[hit], near[hit] = np.take_along_axis(both, at, 1), np.take_along_axis(rows, at, 1)
        limit[hit] = np.minimum(limit[hit], dist[hit].max(1))
    return dist, near


def search(embeddings: DataFrame, *, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", probed: float = PROBED) -> DataFrame:
    """The ``k`` nearest rows of each row whose id divides by ``every``: query_id, rank, vec_id, score."""
    rows, d = V.valid(embeddings, vec_id=vec_id, embedding=embedding, zero=False)
    rows = V.keyed(rows, d)
    many = rows.count()
    parts = V.parts_of(many)
    everything = stored(V.distinct(rows, k + 1, parts), "ann-vectors")
    queries = stored(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "key", "vec").distinct(), "ann-queries")
    n = everything.count()
    own = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    sample = everything.where(own < int((1 << 30) * min(1.0, SAMPLE / max(1, n)))).select("vec", "ids").collect() or everything.limit(1).select("vec", "ids").collect()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not sample:
        return embeddings.sparkSession.createDataFrame([], schema)
    norm = everything.mapInArrow(largest_norm(d), "norm double").agg(F.max("norm")).first()[0]
    index = Index(np.frombuffer(b"".join(r[0] for r in sample), np.float64).reshape(-1, d), [r[1] for r in sample], norm, max(1, int(np.sqrt(n))))
    lists = len(index.centroids)
    placed = stored(assigned(everything, index, d), "ann-lists")
    sizes = dict(placed.groupBy("list").count().collect())  # one row a list, and lists are bounded by the sample
    blocks = {i: -(-m // BLOCK) for i, m in sizes.items()}
    cut = F.create_map(*(x for i, m in blocks.items() for x in (F.lit(i), F.lit(m))))
    placed = placed.withColumn("part", F.col("list").cast("long") * (1 << 32) + F.pmod(F.xxhash64("key"), cut[F.col("list")].cast("long")))
    asked = queries.select("key", "vec").dropDuplicates(["key"])
    probes = probing(asked, index, d, k, max(LEAST_PROBED, int(np.ceil(probed * lists))), blocks)
    found = placed.select("part", "vec", "ids").groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(block_search(index, d, k), V.FOUND).unionByName(asked.mapInArrow(sample_search(index, d, k), V.FOUND))
    return V.ranked(queries, V.merged(found, k + 1, parts), k, F.col("hit.scores"))


def largest_norm(d: int):
    def run(batches):
        for b in batches:
            x = V.unpack(b.column(1), d)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(1)).max(initial=0))])], ["norm"])

    return run


def assigned(everything: DataFrame, index: Index, d: int) -> DataFrame:
    schema = T.StructType([*V.DISTINCT.fields, T.StructField("list", T.IntegerType())])

    def run(batches):
        for b in batches:
            near = np.argmin(index.nearness(index.rotated(V.unpack(b.column(1), d))), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], schema.names)

    return everything.mapInArrow(run, schema)


def probing(queries: DataFrame, index: Index, d: int, k: int, probed: int, blocks: dict[int, int]) -> DataFrame:
    """One row for each block a query probes, with its first threshold."""
    schema = T.StructType([T.StructField("part", T.LongType()), *V.DISTINCT.fields[:2], T.StructField("limit", T.DoubleType())])

    def run(batches):
        s = index.sample
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = index.rotated(V.unpack(b.column(1), d), True)
                far = (q * q).sum(1)[:, None] + (s * s).sum(1) - 2 * q @ s.T
                limit = np.partition(far, k, 1)[:, k] if len(s) > k else np.full(len(q), np.inf)
                order = np.argsort(index.nearness(q), 1)[:, :probed]
                pairs = [(i, int(li) * (1 << 32) + m) for i in range(len(q)) for li in order[i] for m in range(blocks.get(int(li), 0))]
                rows = pa.array([i for i, _ in pairs], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in pairs], pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(limit[[i for i, _ in pairs]], pa.float64())], schema.names)

    return queries.select("key", "vec").mapInArrow(run, schema)


def sample_search(index: Index, d: int, k: int):
    """The sample's best for each query."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], []]
            for q in V.unpack(b.column(1), d):
                score = np.einsum("ij,j->i", index.original, q)
                own = np.argpartition(-score, min(k + 1, len(score) - 1))[: k + 2]
                top = V.best([(float(score[r]), i) for r in own for i in index.ids[r]], k + 1)
                for c, v in zip(out, ([i for _, i in top], [v for v, _ in top])):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float64()))], V.FOUND.names)

    return run


def block_search(index: Index, d: int, k: int):
    """A block's vectors against the queries that probe it."""

    def run(block: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if block.num_rows and probes.num_rows:
            x, ids = V.unpack(block.column("vec"), d), block.column("ids").to_pylist()
            turned = index.rotated(x)
            keys = probes.column("key").to_pylist()
            q = V.unpack(probes.column("vec"), d)
            limit = probes.column("limit").to_numpy()
            for s in range(0, len(q), 512):
                _, near = scan(turned, index.rotated(q[s : s + 512], True), limit[s : s + 512], k + 1)
                for j, own in enumerate(near):
                    own = own[own >= 0]
                    if len(own):
                        score = np.einsum("ij,j->i", x[own], q[s + j])
                        top = V.best([(float(v), i) for v, r in zip(score, own) for i in ids[r]], k + 1)
                        for c, v in zip(out, (keys[s + j], [i for _, i in top], [v for v, _ in top])):
                            c.append(v)
        return pa.table({"key": pa.array(out[0], pa.binary()), "ids": pa.array(out[1], pa.list_(pa.int64())), "scores": pa.array(out[2], pa.list_(pa.float64()))})

    return run
