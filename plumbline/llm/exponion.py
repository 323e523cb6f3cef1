"""Exact Lloyd clustering by Exponion search.

Vectors become whole numbers, ``floor(scale * x)``, and lie in blocks of up to ``BLOCK`` rows: a row of the table holds a block's
ids, vectors, centroid numbers and two bounds a vector, one above the distance to its own centroid and one below
the distance to any other. A round moves the bounds by what the centroids moved. A vector whose upper bound is under
its lower bound, or under half the way to the nearest other centroid, keeps its centroid unseen; of the
others the upper bound is made exact, and those that still fail scan the centroids in a ball around their own centroid of radius
``2 * upper + (way to the nearest other centroid)``, taken from the sorted list of ways between centroids. The radius is
inclusive, bounds give way by a rounding margin and distances are exact, so that ties go to the smaller number.

A round is one pass in place, without a shuffle of vectors; only sums (``k * dims`` longs a block, added up map-side) move.
Blocks and bounds are persisted on memory and disk, each round from the one before: a lost executor's blocks are computed again from the
stored vectors and the centroids of the rounds so far, which go along (``k * dims`` numbers each).

Defined results: rows whose vector is null, not of ``dims`` components, or holds null or non-finite components (also once
multiplied by ``scale``) take no part; a null id hashes as empty text; rows alike in id are told apart by their vectors, and rows alike in both take part each;
with fewer than ``k`` vectors each is a centroid; an empty table gives an empty result; a distance or an
inertia beyond a long is null; other columns of the input take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from plumbline.llm.common import stored

BLOCK = 8192
#: Up to this magnitude of components, squares sum up exactly in doubles (64 * (2 ** 23) ** 2 < 2 ** 53); beyond, whole numbers of any size are used.
DOUBLES = 2.0**22
RAW = "ids binary, vecs binary"
STATE = f"{RAW}, own binary, upper binary, lower binary"
SUMS = "counts array<long>, sums array<string>"


def kept(embeddings: DataFrame, dims: int, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec) of the rows that take part; vectors hold whole numbers as doubles."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).where(F.size("vec") == dims)
    rows = rows.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf"))))
    return rows.select("id", F.transform("vec", lambda x: F.rint(x * scale - F.pmod(x * scale, F.lit(1.0)))).alias("vec"))


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of rows: ids (a null id is the least long) and vectors as bytes."""

    def run(batches):
        have: list = []
        n = 0
        for b in batches:
            have.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield out(have)
                have, n = [], 0
        if n:
            yield out(have)

    def out(have):
        t = pa.Table.from_batches(have)
        ids = t.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        x = np.concatenate([c.flatten().to_numpy() for c in t.column(1).chunks]).reshape(-1, dims)
        return pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([x.astype(np.float64).tobytes()], pa.binary())], ["ids", "vecs"])

    return rows.mapInArrow(run, RAW)


def whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """The numbers as they are added and multiplied: doubles where those are exact, else whole numbers of any size."""
    return x if exact else np.vectorize(int, otypes=[object])(x).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids, one column each."""
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Geometry:
    """What a round needs of the centroids: ways between them, each one's list by way, and how far each moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.c, k = centroids, len(centroids)
        way = roots(squared(centroids, centroids))
        np.fill_diagonal(way, np.inf)
        self.nearest = way.min(1)
        np.fill_diagonal(way, 0.0)
        self.order = np.argsort(way, 1, kind="stable")
        self.sorted = np.take_along_axis(way, self.order, 1)
        moved = roots(((centroids - before) ** 2).sum(1)) if before is not None else np.zeros(k)
        self.moved = moved * (1 + 1e-12)
        most = np.argsort(-self.moved, kind="stable")
        self.others = np.full(k, self.moved[most[0]])
        self.others[most[0]] = self.moved[most[1]] if k > 1 else 0.0


def first_round(x: np.ndarray, g: Geometry):
    d = squared(x, g.c)
    own = d.argmin(1)
    r = roots(d)
    upper = r[np.arange(len(x)), own].copy()
    r[np.arange(len(x)), own] = np.inf
    return own, upper, r.min(1)


def next_round(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, g: Geometry):
    """Numbers and bounds after a move of the centroids; the third result counts distances computed."""
    own, upper, lower = own.copy(), (upper + g.moved[own]) * (1 + 1e-12), (lower - g.others[own]) * (1 - 1e-12)
    seen = 0
    bound = np.maximum(lower, g.nearest[own] / 2)
    open_ = np.flatnonzero(~(upper * (1 + 1e-9) < bound))
    if len(open_):
        seen += len(open_)
        upper[open_] = roots(((x[open_] - g.c[own[open_]]) ** 2).sum(1))
        open_ = open_[~(upper[open_] * (1 + 1e-9) < bound[open_])]
    radius = (2 * upper[open_] + g.nearest[own[open_]]) * (1 + 1e-9)
    for a in np.unique(own[open_]):
        rows, reach = open_[own[open_] == a], radius[own[open_] == a]
        many = np.searchsorted(g.sorted[a], reach, "right")
        for m in np.unique(many):
            part = rows[many == m]
            near = np.sort(g.order[a, :m])  # by number, so that the first least one is the smallest
            d = squared(x[part], g.c[near])
            seen += d.size
            best = d.argmin(1)
            r = roots(d)
            at = np.arange(len(part))
            own[part], upper[part] = near[best], r[at, best]
            r[at, best] = np.inf
            lower[part] = r.min(1) if m > 1 else np.inf
    return own, upper, lower, seen


def round_of(centroids: np.ndarray, before: np.ndarray | None, dims: int, exact: bool):
    def run(batches):
        g = Geometry(centroids, before)
        for b in batches:
            for row in b.to_pylist():
                x = whole(np.frombuffer(row["vecs"]).reshape(-1, dims), exact)
                if before is None:
                    own, upper, lower = first_round(x, g)
                else:
                    own, upper, lower, _ = next_round(x, np.frombuffer(row["own"], np.int32), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]), g)
                values = [row["ids"], row["vecs"], own.astype(np.int32).tobytes(), upper.astype(np.float64).tobytes(), lower.astype(np.float64).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["ids", "vecs", "own", "upper", "lower"])

    return run


def totals(state: DataFrame, k: int, dims: int, exact: bool) -> tuple[list[int], list[list[int]]]:
    """Rows and sums of each centroid's vectors, added up by task and then over tasks; ``k`` counts and ``k * dims`` sums reach the driver."""

    def run(batches):
        counts, sums = [0] * k, np.zeros((k, dims), object)
        for b in batches:
            for vecs, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, own = whole(np.frombuffer(vecs).reshape(-1, dims), exact), np.frombuffer(own, np.int32)
                for a in np.unique(own):
                    part = x[own == a]
                    counts[a] += len(part)
                    sums[a] += np.array([int(v) for v in part.sum(0)], object)
        yield pa.RecordBatch.from_arrays([pa.array([counts], pa.list_(pa.int64())), pa.array([[str(v) for v in sums.ravel()]], pa.list_(pa.string()))], ["counts", "sums"])

    part = state.select("vecs", "own").mapInArrow(run, SUMS)
    every = F.concat(F.transform("counts", lambda x: x.cast("decimal(38,0)")), F.transform("sums", lambda x: x.cast("decimal(38,0)")))
    rows = part.select(F.posexplode(every).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = [0] * (k + k * dims)
    for r in rows:
        flat[r["at"]] = int(r["v"])
    return flat[:k], [flat[k + a * dims : k + (a + 1) * dims] for a in range(k)]


def numbers(c: list[list[int]], exact: bool) -> np.ndarray:
    return np.array(c, np.float64 if exact else object).reshape(len(c), -1)


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of seed and id; ``k`` rows reach the driver."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    top = rows.select(F.sha2(text, 256).alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    return [[int(v) for v in r["vec"]] for r in top]


def cluster(embeddings: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every vector that takes part."""
    rows = stored(kept(embeddings, dims, scale, vec_id, embedding), "exponion-rows")
    exact = (rows.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x))))).first()[0] or 0.0) <= DOUBLES
    start = first_centroids(rows, k, seed)
    if not start:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k, raw = len(start), stored(packed(rows, dims), "exponion-blocks")
    now, before, state = start, None, raw
    for at in range(rounds + 1):
        old = state
        state = old.mapInArrow(round_of(numbers(now, exact), None if before is None else numbers(before, exact), dims, exact), STATE).persist(StorageLevel.MEMORY_AND_DISK)
        if at < rounds:
            counts, sums = totals(state, k, dims, exact)
            before, now = now, [[s // n for s in ss] if n else c for n, ss, c in zip(counts, sums, now)]
        else:
            result = stored(distances(state, numbers(now, exact), dims, exact), "exponion-result")
        if old is not raw:
            old.unpersist()
    state.unpersist()
    sums = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("known"), F.count(F.lit(1)).alias("n")).collect()
    by = {r["cluster"]: int(r["s"]) if r["known"] == r["n"] else 1 << 63 for r in sums}
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    ends = F.array(*(F.struct(F.lit(fits(by.get(a))).cast("long").alias("s"), F.lit(digest[a]).alias("d")) for a in range(k)))
    end = F.get(ends, F.col("cluster"))
    return result.select("vec_id", "cluster", "distance", end["s"].alias("cluster_inertia"), F.lit(fits(sum(by.values()))).cast("long").alias("inertia"), end["d"].alias("centroid_sha256"))


def distances(state: DataFrame, centroids: np.ndarray, dims: int, exact: bool) -> DataFrame:
    """One row a vector: id, centroid and exact squared distance."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int32)
                x = whole(np.frombuffer(row["vecs"]).reshape(-1, dims), exact)
                d = ((x - centroids[own]) ** 2).sum(1)
                d = pa.array(d.astype(np.int64)) if exact else pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == np.iinfo(np.int64).min), pa.array(own), d], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def oracle(*, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The rounds one after another, with every distance computed."""
    sql = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({scale} * x) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: NOT coalesce(isfinite(x), false))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k})",
    ]
    for t in range(rounds + 1):
        sql.append(
            f"""a{t} AS MATERIALIZED (
  SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.r, c.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{t} c) GROUP BY r)"""
        )
        if t < rounds:
            sql.append(
                f"""c{t + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN (
    SELECT c, list(y ORDER BY i) AS x FROM (
      SELECT c, i, CAST((sum(z) - ((sum(z) % count(*) + count(*)) % count(*))) // count(*) AS BIGINT) AS y FROM (
        SELECT a.c, unnest(range(1, {dims + 1})) AS i, unnest(v.x) AS z FROM a{t} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"""
            )
    return f"""WITH {", ".join(sql)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.c"""


ORACLE = oracle()
