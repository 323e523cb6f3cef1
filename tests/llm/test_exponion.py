import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import exponion

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k, rounds, dims, scale=1024):
    """Plain rounds over whole numbers of any size."""
    good = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(((name(i), v) for i, v in good))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in good]
        for j in range(len(c)):
            part = [v for (_, v), a in zip(good, own) if a == j]
            if part:
                c[j] = [sum(col) // len(part) for col in zip(*part)]
    end = [near(v) for _, v in good]
    by = {j: sum(d for d, a in end if a == j) for j in range(len(c))}
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, fit(d), fit(by[j]), fit(sum(by.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(good, end)), key=str)


def found(df, **how):
    got = exponion.cluster(df, **how)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def rows_of(x, first=0):
    return [(first + i, [float(a) for a in v], 1, "clash", "") for i, v in enumerate(x)]


ODD = [(900, None, 1, "", ""), (901, [], 1, "", ""), (902, [1.0], 1, "", ""), (903, [float("nan")] * 4, 1, "", ""), (904, [None, 1.0, 1.0, 1.0], 1, "", ""), (905, [float("-inf"), 0.0, 0.0, 0.0], 1, "", ""), (None, [0.5] * 4, 1, "", "")]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_plain_rounds(spark, seed, monkeypatch):
    monkeypatch.setattr(exponion, "BLOCK", 64)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 4)) * 3
    x = centre[rng.integers(5, size=300)] + rng.normal(size=(300, 4))
    rows = rows_of(x) + rows_of(np.repeat(x[:1], 100, 0), 400) + rows_of(x[:3], 10) + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, k=5, rounds=6, dims=4) == brute(rows, 5, 6, 4)


def test_ties_go_to_the_smaller_number(spark):
    """Points of a small lattice: many distances and ways between centroids are equal."""
    rng = np.random.default_rng(2)
    rows = rows_of(rng.integers(-2, 3, size=(250, 4)) / 1024)
    assert found(spark.createDataFrame(rows, SCHEMA), k=7, rounds=5, dims=4) == brute(rows, 7, 5, 4)


def test_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng.normal(size=(60, 4)) * 1e9)
    assert found(spark.createDataFrame(rows, SCHEMA), k=3, rounds=3, dims=4) == brute(rows, 3, 3, 4)


def test_few_and_none(spark):
    same = rows_of(np.ones((3, 4)))
    assert found(spark.createDataFrame(same, SCHEMA), k=8, rounds=2, dims=4) == brute(same, 8, 2, 4)
    assert found(spark.createDataFrame(same[:1], SCHEMA), k=8, rounds=2, dims=4) == brute(same[:1], 8, 2, 4)
    assert found(spark.createDataFrame([], SCHEMA), dims=4) == []
    assert found(spark.createDataFrame(ODD[:6], SCHEMA), dims=4) == []


def test_bounds_spare_most_distances():
    """Far fewer distances than rows times centroids on clustered vectors, and never another centroid."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 8)) * 4000
    x = np.floor(centre[rng.integers(40, size=4000)] + rng.normal(size=(4000, 8)) * 200)
    c, seen = x[rng.choice(4000, 40, replace=False)].copy(), 0
    own, upper, lower = exponion.first_round(x, exponion.Geometry(c, None))
    for _ in range(8):
        new = np.stack([np.floor(x[own == a].mean(0)) if (own == a).any() else c[a] for a in range(40)])
        own, upper, lower, n = exponion.next_round(x, own, upper, lower, exponion.Geometry(new, c))
        assert (own == exponion.squared(x, new).argmin(1)).all()
        c, seen = new, seen + n
    assert seen < 0.3 * 8 * 4000 * 40
