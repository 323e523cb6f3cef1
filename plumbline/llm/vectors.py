"""What the two vector searches share: valid vectors, distinct vectors, blocks and merging of partial results."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_ROWS = 20_000
FLUSH = 20_000
DISTINCT = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("vec", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType()))])
FOUND = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def valid(embeddings: DataFrame, *, vec_id: str, embedding: str, zero: bool) -> tuple[DataFrame, int]:
    """Rows (id, vec as doubles) whose vector takes part, and its dimension: the one that most rows have, the smaller of several.

    Vectors that are null, empty, of another dimension, or hold null or non-finite components take no part, nor
    do zero vectors if ``zero`` is false; nor do rows with a null id.
    """
    vec = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    rows = rows.where(~F.exists("vec", bad))
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 1
    return rows.where(F.size("vec") == d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column of ``d`` doubles a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64, copy=False)


def unpack(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def key_of(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(raw)


def integers(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 256.0)


def keyed(rows: DataFrame, d: int, change=None) -> DataFrame:
    """(id, key, vec bytes) of rows; ``change`` maps the matrix first."""
    schema = T.StructType([T.StructField("id", T.LongType()), *DISTINCT.fields[:2]])

    def run(batches):
        for b in batches:
            m = matrix(b.column(1), d)
            raw = [x.tobytes() for x in (change(m) if change else m) + 0.0]  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(key_of, raw), pa.binary()), pa.array(raw, pa.binary())], schema.names)

    return rows.select("id", "vec").mapInArrow(run, schema)


def distinct(rows: DataFrame, most: int, parts: int) -> DataFrame:
    """Distinct vectors of ``keyed`` rows, each with its ``most`` smallest ids: copies of a vector score alike, so no larger id can be among the first ``most``. Ids are cut before and after the shuffle."""

    def merge(batches):
        have: dict[bytes, tuple[bytes, list[int]]] = {}

        def out():
            vals = list(have.items())
            have.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in vals], pa.binary()), pa.array([v for _, (v, _) in vals], pa.binary()), pa.array([sorted(set(i))[:most] for _, (_, i) in vals], pa.list_(pa.int64()))], DISTINCT.names)

        flush = merge.flush
        for b in batches:
            for k, v, ids in zip(*(c.to_pylist() for c in b.columns)):
                own = have.setdefault(k, (v, []))[1]
                own.extend(ids)
                if len(own) > 4 * most:
                    own[:] = sorted(set(own))[:most]
            if flush and len(have) > FLUSH:
                yield out()
        if have:
            yield out()

    def first(batches):
        merge.flush = True
        yield from merge(batches)

    def last(batches):
        merge.flush = False
        yield from merge(batches)

    own = rows.select("key", "vec", F.array("id").alias("ids"))
    return own.mapInArrow(first, DISTINCT).repartition(parts, F.xxhash64("key")).mapInArrow(last, DISTINCT)


def merged(found: DataFrame, most: int, parts: int) -> DataFrame:
    """The best ``most`` (score, id) of each key over the partial results of its blocks."""

    def run(batches):
        have: dict[bytes, list] = {}
        for b in batches:
            for k, ids, scores in zip(*(c.to_pylist() for c in b.columns)):
                own = have.setdefault(k, [])
                own.extend(zip(scores, ids))
                if len(own) > 8 * most:
                    own[:] = best(own, most)
        tops = {k: best(v, most) for k, v in have.items()}
        if tops:
            yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.binary()), pa.array([[i for _, i in v] for v in tops.values()], pa.list_(pa.int64())), pa.array([[s for s, _ in v] for v in tops.values()], pa.list_(pa.float64()))], FOUND.names)

    return found.repartition(parts, F.xxhash64("key")).mapInArrow(run, FOUND)


def best(pairs, most: int) -> list:
    return heapq.nsmallest(most, set(pairs), key=lambda x: (-x[0], x[1]))


def ranked(queries: DataFrame, tops: DataFrame, k: int, score: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row: its key's best without itself."""
    own = queries.select("id", "key").join(tops, "key").select("id", F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("id")), 1, k).alias("top"))
    own = own.select("id", F.posexplode("top").alias("at", "hit"))
    return own.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias("vec_id"), score.alias("score"))


def parts_of(n: int, least: int = 16) -> int:
    return max(least, math.ceil(n / PART_ROWS))
