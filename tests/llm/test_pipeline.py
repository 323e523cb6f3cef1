import random

import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    out = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(300):
        ws = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(10, 80))]
        bad = i % 6 == 0
        if bad:
            ws[2:2] = ["vile", "rotten"]
        rows.append((i, " ".join(ws), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(400 + i, rows[1][1] + f" tail{i}", "en", "s1", 0) for i in range(20)] + [(500, rows[2][1], "en", "s2", 0), (501, None, None, None, None), (502, "", "en", "s0", 0), (None, "a b c d e f", "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def test_stages_and_run(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.collect()}
    assert not any(i % 6 == 0 and i < 300 for i in kept["toxicity"] if i is not None)
    assert {i for i in range(300) if i % 6} <= kept["toxicity"]
    near = {i for i in kept["jaccard"] if i is not None}
    assert len(near & ({1} | set(range(400, 420)))) == 1 and 500 not in near
    assert {i for i in range(300) if i % 6} <= near
    done = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "token_ids", "n_tokens", "decoded_sha256"} <= set(done.columns)
    assert done.count() == docs.count()
