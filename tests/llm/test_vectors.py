import collections

import numpy as np
import pytest

from plumbline.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string"


def table(spark, n=1500, d=16, seed=0, copies=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) * rng.uniform(0.2, 2, (n, 1)).astype(np.float32)
    x[n - copies :] = x[0]
    rows = [(i, v.tolist(), 1, "clash") for i, v in enumerate(x)]
    odd = [(n + 1, None, 1, ""), (n + 2, [0.0] * d, 1, ""), (n + 3, [float("nan")] * d, 1, ""), (n + 4, [float("inf")] + [1.0] * (d - 1), 1, ""), (n + 5, [None] + [1.0] * (d - 1), 1, ""), (n + 6, [1.0], 1, ""), (None, x[1].tolist(), 1, ""), (20, x[20].tolist(), 1, "again")]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3), {i: v.astype(np.float64) for i, v in enumerate(x)}


def brute(x, every, k):
    ids, m = np.array(list(x)), np.array(list(x.values()))
    out = {}
    for i in ids[ids % every == 0]:
        s = m @ m[list(ids).index(i)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def collected(df):
    got = collections.defaultdict(list)
    for r in sorted(df.collect()):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_ann_recall_and_scores(spark):
    df, x = table(spark)
    got, want = collected(ann.search(df)), brute(x, 20, 20)
    assert got.keys() == want.keys()
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert len(rows) == 20
        for v, s in rows:
            assert abs(s - x[v] @ x[q]) < 1e-9
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_scan_abandons_few_wrongly():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 33)), rng.normal(size=(20, 33))
    dist, near = ann.scan(x, q, np.full(20, np.inf), 10)
    true = np.argsort(((x[None] - q[:, None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near, true)]) >= 9.5


@pytest.mark.parametrize("seed", [0, 3])
def test_topk_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "SAMPLE", 64)
    df, x = table(spark, seed=seed)
    x = {i: np.floor(256 * v) for i, v in x.items()} | {1502: np.zeros(16)}
    got, want = collected(topk.search(df)), brute(x, 50, 5)
    assert {q: [(v, float(s)) for v, s in r] for q, r in got.items()} == want


def test_topk_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "SAMPLE", 50)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 16))
    x = {i: v for i, v in enumerate((centre[np.arange(600) % 5] + rng.normal(size=(600, 16)) * 0.1).astype(np.float32).astype(np.float64))}
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in x.items()], SCHEMA)
    got = collected(topk.search(df))
    assert {q: [(v, float(s)) for v, s in r] for q, r in got.items()} == brute({i: np.floor(256 * v) for i, v in x.items()}, 50, 5)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (20, [1.0, 2.0], 0, ""), (3, [-1.0, 0.5], 0, ""), (100, [2.0, 0.0], 0, "")], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in sorted(ann.search(few).collect())] == [(0, 20), (0, 100), (0, 3), (20, 0), (20, 100), (20, 3), (100, 0), (100, 20), (100, 3)]
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(topk.search(few).collect())] == [(0, 20, 327680), (0, 100, 131072), (0, 3, 0), (100, 0, 131072), (100, 20, 131072), (100, 3, -131072)]
    for find in (ann.search, topk.search):
        assert find(few.limit(0)).count() == 0
        assert find(few.where("vec_id = 0")).count() == 0
