import itertools

import numpy as np

from plumbline.llm import toxicity


def brute(e, trans, start):
    total, m = 0.0, np.zeros(len(e))
    for y in itertools.product((0, 1), repeat=len(e)):
        s = (start if y[0] else 1) * np.prod([np.exp(x) for x, v in zip(e, y) if v]) * np.prod([trans[a, b] for a, b in zip(y, y[1:])])
        total, m = total + s, m + s * np.array(y)
    return m / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    trans, start = np.exp(rng.normal(size=(2, 2))), 0.3
    lengths = np.array([3, 0, 7, 1, 10])
    e = rng.normal(size=lengths.sum()) * 2
    got, at = toxicity.marginals(e, lengths, trans, start), 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], brute(e[at : at + n], trans, start))
        at += n


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([3, 700, 5000, 256, 257, 512])
    e, trans = rng.normal(size=lengths.sum()) * 3, np.array([[1.7, 0.03], [0.5, 1.6]])
    a = toxicity.marginals(e, lengths, trans, 0.03)
    monkeypatch.setattr(toxicity, "SEGMENT", 100_000)
    assert np.allclose(a, toxicity.marginals(e, lengths, trans, 0.03))


def rows(n):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(80)], ["vile", "rotten", "foul"]
    out = []
    for i in range(n):
        ws = rng.choice(plain, rng.integers(5, 60)).tolist()
        if i % 5 == 0:
            for w in rng.choice(bad, 2):
                ws.insert(int(rng.integers(0, len(ws))), str(w))
        out.append((" ".join(ws), int(i % 5 == 0)))
    return out


def test_learns_and_tells_places(spark):
    model = toxicity.train(rows(600))
    texts = ["word1 vile word2 foul", "word1 word2 word3", None, "", "Rotten! word5 VILE", "word7 " * 30_000, "word7 " * 20_000 + "vile foul"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, toxicity string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [got[i].toxicity >= 0.5 for i in range(7)] == [True, False, False, False, True, False, True]
    assert got[2].toxicity == got[3].toxicity
    assert [texts[0][s.start : s.end] for s in got[0].toxic_spans] == ["vile", "foul"]
    held = toxicity.train(rows(600)).score_batch([toxicity.tokens(t) for t, _ in rows(900)[600:]], {})[2]
    assert np.mean((held >= 0.5) == np.array([y for _, y in rows(900)[600:]])) > 0.95


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.fit(toxicity.labelled(docs, labels))
    assert none.share == 0.0 and [r.toxicity for r in toxicity.score(docs, none).collect()] == [0.0, 0.0]
    assert [r.toxicity for r in toxicity.score(docs, toxicity.train([])).collect()] == [0.0, 0.0]
    assert toxicity.train([("a b", 1), ("c d", 1)]).share == 1.0
    assert toxicity.score(docs.limit(0), toxicity.train(rows(100))).count() == 0


def test_sample_is_bounded_and_fits_in_a_task(spark):
    data = [(i, t, y) for i, (t, y) in enumerate(rows(400))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(3, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled(docs, labels, per_class=40)
    got = sample.groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {1: 40, 0: 80}
    model = toxicity.fit(sample)
    p = [r.toxicity for r in toxicity.score(docs.where("doc_id < 100 AND text <> 'again'").orderBy("doc_id"), model).collect()]
    assert sum((x >= 0.5) == (y == 1) for x, (_, _, y) in zip(p, data)) >= 95
