import hashlib

import pytest

from plumbline.llm import secret_scan as ss


@pytest.fixture(scope="module")
def model(spark):
    return ss.train(ss.findings(spark, 2000))


def test_held_out_findings(spark, model):
    rows = model.transform(ss.assembled(ss.findings(spark, 5000).subtract(ss.findings(spark, 2000)))).select("label", "prediction").collect()
    assert len(rows) > 1000 and sum(r.label == r.prediction for r in rows) >= 0.97 * len(rows)


def test_places_and_decisions(spark, model):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'some words token = "{key}" end', f"commit {key}\nnext", None, "", "short", "é" * 30 + f" api_key: {key[::-1]} and " + "verylongwordofthetext" * 2, "a" * 100_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, start string")
    got = ss.scan(docs, model).collect()
    by = {(r.doc_id, r.nth): r for r in got}
    assert by[0, 1].is_secret and by[None, 1].is_secret and not by[1, 1].is_secret and by[5, 1].is_secret and not by[5, 2].is_secret and not by[6, 1].is_secret
    assert len(got) == 6
    for r in got:
        t = texts[0 if r.doc_id is None else r.doc_id]
        assert hashlib.sha256(t[r.start - 1 : r.start - 1 + r.length].encode()).hexdigest() == r.sha256
    assert ss.scan(docs.limit(0), model).count() == 0
