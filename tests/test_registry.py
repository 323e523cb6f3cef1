from plumbline.operators import documents
from plumbline.sources import registry as R


def test_cases_and_chunks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"case_id": "one", "x": 1}')
    (tmp_path / "b.json").write_text('{"case_id": "two", "x": 2}')
    assert sorted(r.case_id for r in R.cases(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert [r.x for r in R.cases(spark, str(tmp_path), "two").collect()] == [2]
    r = R.chunks(spark.createDataFrame([("t", "d", "0.5")], "Page_Content string, document_id string, similarity string")).first()
    assert (r.chunk_id, r.text, r.source_doc_id, r.score) == (None, "t", "d", 0.5)


def test_calibration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"mode": "temperature", "params": {"t": 1.5}}')
    (tmp_path / "bad.json").write_text("{")
    assert R.calibration(spark, str(tmp_path / "c.json")) == {"mode": "temperature", "params": {"t": 1.5}}
    assert R.calibration(spark, str(tmp_path / "bad.json"))["mode"] == R.calibration(spark, str(tmp_path / "none.json"))["mode"] == "none"


def test_profiles():
    text = "name: titles  # by title\nstrategy: by_title\nlimits:\n  structure: 0.7\n  page: 1.2\ntags:\n  - a\n  - b\n"
    found = R.profile(text)
    assert found == {"name": "titles", "strategy": "by_title", "limits": {"structure": 0.7, "page": 1.2}, "tags": ["a", "b"]}
    assert R.profile(R.profile_text(found)) == found and R.profile('{"name": "x"}') == {"name": "x"}
    assert documents.lint(found) == ["unknown key: tags", "share out of range: page"]
    assert documents.lint({"strategy": "x", "metadata": {"a": ["p"], "b": ["p"]}, "least_chars": 5, "most_chars": 2}) == ["missing key: name", "path twice: p", "least_chars over most_chars"]


def test_providers(spark):
    p = R.Providers()
    p.add("mine", lambda runs: runs.selectExpr("run_id", "'faithfulness' AS metric", "0.25 AS value"))
    p.add("other", lambda runs: runs, ("no_such_module",))
    assert p.ready() == {"mine": "ready", "other": "lacks no_such_module"}
    runs = spark.createDataFrame([("r",)], "run_id string")
    assert [tuple(r) for r in p.signals(runs).collect()] == [("r", "mine", "faithfulness", 0.25)]
    assert R.Providers().signals(runs).count() == 0


def test_parser_findings(spark):
    docs = spark.createDataFrame([("a", "web", {"Title": "t"}), ("b", "web", {"title": " "}), ("c", "wiki", {})], "doc_id string, domain string, metadata map<string,string>")
    found = documents.governance(docs, [("web", "date", "warn"), ("web", "title", "fail"), ("wiki", "title", "warn")])
    placed = {(r.doc_id, r.field): r.place for r in documents.by_severity(found, by=["doc_id"]).collect()}
    assert placed == {("a", "date"): 1, ("b", "title"): 1, ("b", "date"): 2, ("c", "title"): 1}
    assert {r.status: r.n for r in documents.ingestion_summary(found, docs).collect()} == {"fail": 1, "warn": 2}
