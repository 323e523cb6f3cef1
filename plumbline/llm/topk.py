"""Exact largest inner products by norm buckets with coordinate or length pruning.

Vectors are ordered into buckets by length (at most ``MOST_BUCKETS``, by approximate quantiles; a
crowded bucket is cut into blocks by the key's hash). A query's threshold begins with its (k+1)-th best
score over a bounded sample of the longest and of random vectors and rises as blocks are read; a bucket
whose longest vector cannot reach it gets no row for the query. In a block the local cosine threshold
t = threshold / (|q| * longest) decides: from ``COORDINATE`` up, the query's largest coordinates give
the interval that a vector's normalised coordinate must lie in for a cosine of t, and the sorted lists of
those coordinates give the candidates; below, vectors are met by falling length until none can reach the
threshold. Candidates are verified by their whole integer product. All pruning is by bounds, so results are exact.

Defined results: see ``vectors.valid`` for rows that take no part (zero vectors do); ties go to the
smaller id; copies of a vector are one candidate with its smallest ids; with fewer candidates than k a
query has fewer rows; an empty table gives an empty result. Components are floor(256 * x); sums of
products are exact below 2**53.
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
BLOCK = 4096
MOST_BUCKETS = 1024
COORDINATE = 0.45
FOCUS = 4


class Block:
    """A block's vectors by falling length, with the sorted list of each normalised coordinate."""

    def __init__(self, x: np.ndarray, ids: list[list[int]]):
        norm = np.sqrt((x * x).sum(1))
        order = np.argsort(-norm, kind="stable")
        self.x, self.norm, self.ids = x[order], norm[order], [ids[i] for i in order]
        self.unit = self.x / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int):
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, length: float, limit: float) -> np.ndarray:
        """Rows that may score ``limit`` or more."""
        if limit <= 0 or length == 0:  # every vector may
            return np.arange(len(self.x)) if limit <= 0 else np.zeros(0, np.int64)
        reach = int(np.searchsorted(-self.norm, -limit / length * (1 - 1e-9), "right"))
        if not reach:
            return np.zeros(0, np.int64)
        t = limit / (length * self.norm[0])
        if t < COORDINATE:
            return np.arange(reach)
        t = min(1.0, t * (1 - 1e-9))
        focus = np.argsort(-abs(q))[:FOCUS]
        spans = []
        for f in focus:
            u = q[f] / length
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - u * u))) + 1e-9
            # A cosine above t puts the coordinate into the interval too, unless u itself is within its reach.
            low = -1.0 if -u >= t else u * t - wide
            high = 1.0 if u >= t else u * t + wide
            order, values = self.sorted_list(int(f))
            spans.append((int(f), low, high, np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")))
        f, _, _, i, j = min(spans, key=lambda s: s[4] - s[3])
        own = self.sorted_list(f)[0][i:j]
        own = own[own < reach]
        for g, low, high, _, _ in spans:
            if g != f:
                c = self.unit[own, g]
                own = own[(c >= low) & (c <= high)]
        return own

    def search(self, q: np.ndarray, limit: float, k: int) -> list[tuple[float, int]]:
        """The best ``k`` (score, id) of the block that score ``limit`` or more."""
        own = self.candidates(q, float(np.sqrt(q @ q)), limit)
        score = self.x[own] @ q
        keep = score >= limit
        own, score = own[keep], score[keep]
        if len(own) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            own, score = own[score >= least], score[score >= least]
        return V.best([(float(s), i) for s, r in zip(score, own) for i in self.ids[r]], k)


def search(embeddings: DataFrame, *, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` highest integer products of each row whose id divides by ``every``: query_id, rank, vec_id, score."""
    rows, d = V.valid(embeddings, vec_id=vec_id, embedding=embedding, zero=True)
    rows = V.keyed(rows, d, V.integers)
    many = rows.count()
    parts = V.parts_of(many)
    everything = stored(with_norm(V.distinct(rows, k + 1, parts), d), "topk-vectors")
    queries = stored(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "key", "vec").distinct(), "topk-queries")
    n = everything.count()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    buckets = int(min(MOST_BUCKETS, max(1, n // BLOCK + 1)))
    edges = everything.agg(F.percentile_approx("norm", [i / buckets for i in range(1, buckets)] or [1.0], 10_000)).first()[0]
    edges = sorted(set(edges))
    top = everything.agg(F.percentile_approx("norm", max(0.0, 1 - SAMPLE / 4 / n), 10_000)).first()[0]
    chance = int((1 << 30) * min(1.0, SAMPLE / n))
    sample = everything.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < chance).select("vec").unionByName(everything.where(F.col("norm") > top).select("vec").limit(SAMPLE)).distinct().collect()
    sample = np.frombuffer(b"".join(r[0] for r in sample), np.float64).reshape(-1, d)
    placed = everything.withColumn("bucket", bucket_of(edges))
    about = {r["bucket"]: (r["n"], r["longest"]) for r in placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).collect()}
    blocks = {b: -(-m // BLOCK) for b, (m, _) in about.items()}
    cut = F.create_map(*(x for b, m in blocks.items() for x in (F.lit(b), F.lit(m))))
    placed = placed.withColumn("part", F.col("bucket").cast("long") * (1 << 32) + F.pmod(F.xxhash64("key"), cut[F.col("bucket")].cast("long")))
    wanted = probing(queries.select("key", "vec").dropDuplicates(["key"]), sample, d, k, {b: (blocks[b], m) for b, (_, m) in about.items()})
    found = placed.select("part", "vec", "ids").groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(block_search(d, k), V.FOUND)
    return V.ranked(queries, V.merged(found, k + 1, parts), k, F.col("hit.scores").cast("long"))


def bucket_of(edges: list[float]):
    """The number of edges below the norm."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("norm")))


def with_norm(rows: DataFrame, d: int) -> DataFrame:
    schema = T.StructType([*V.DISTINCT.fields, T.StructField("norm", T.DoubleType())])

    def run(batches):
        for b in batches:
            x = V.unpack(b.column(1), d)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.sqrt((x * x).sum(1)))], schema.names)

    return rows.mapInArrow(run, schema)


def probing(queries: DataFrame, sample: np.ndarray, d: int, k: int, buckets: dict[int, tuple[int, float]]) -> DataFrame:
    """One row for each block that may hold a score of the query's first threshold."""
    schema = T.StructType([T.StructField("part", T.LongType()), *V.DISTINCT.fields[:2], T.StructField("limit", T.DoubleType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                q = V.unpack(b.column(1), d)
                score = q @ sample.T
                limit = np.partition(score, len(sample) - k - 1, 1)[:, len(sample) - k - 1] if len(sample) > k else np.full(len(q), -np.inf)
                length = np.sqrt((q * q).sum(1)) * (1 + 1e-9)
                pairs = [(i, bucket * (1 << 32) + m) for bucket, (blocks, longest) in buckets.items() for i in np.flatnonzero(length * longest >= limit).tolist() for m in range(blocks)]
                rows = pa.array([i for i, _ in pairs], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in pairs], pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(limit[[i for i, _ in pairs]], pa.float64())], schema.names)

    return queries.select("key", "vec").mapInArrow(run, schema)


def block_search(d: int, k: int):
    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if block.num_rows and wanted.num_rows:
            own = Block(V.unpack(block.column("vec"), d), block.column("ids").to_pylist())
            for key, q, limit in zip(wanted.column("key").to_pylist(), V.unpack(wanted.column("vec"), d), wanted.column("limit").to_pylist()):
                if top := own.search(q, limit, k + 1):
                    for c, v in zip(out, (key, [i for _, i in top], [s for s, _ in top])):
                        c.append(v)
        return pa.table({"key": pa.array(out[0], pa.binary()), "ids": pa.array(out[1], pa.list_(pa.int64())), "scores": pa.array(out[2], pa.list_(pa.float64()))})

    return run
