from datetime import datetime

from pyspark.sql import functions as F

from plumbline.llm import url_filter as uf

LOG = (
    ("domain", "bad.com", "/", "add", "2024-01-10", "spam"),
    ("domain", "bad.com", "/", "remove", "2024-02-10", "spam"),
    ("domain", "bad.com", "/", "add", "2024-03-10", "malware"),
    ("host", "x.org", "/", "add", "2024-01-01", "adult"),
    ("domain", "shop.net", "/pills", "add", "2024-01-01", "pharmacy"),
    ("domain", "tie.com", "/", "add", "2024-01-01", "spam"),
    ("domain", "tie.com", "/", "remove", "2024-01-01", "spam"),
    ("domain", "deep.bad.com", "/", "add", "2024-03-01", "phishing"),
)


def judged(spark, rows):
    caps = spark.createDataFrame([(i, u, datetime.fromisoformat(t) if t else None, "clash") for i, (u, t) in enumerate(rows)], "page_id long, url string, fetched_at timestamp, category string")
    return {r.page_id: r for r in uf.judge(caps, uf.entries(spark, LOG)).collect()}


def test_scopes_and_times(spark):
    cases = [
        ("http://bad.com/a", "2024-01-09", False), ("http://bad.com/a", "2024-01-10", True), ("https://u:p@WWW.Bad.com.:8080/x?q#f", "2024-02-09", True),
        ("http://bad.com/a", "2024-02-10", False), ("http://bad.com", "2024-03-11", True), ("http://notbad.com/", "2024-03-11", False),
        ("http://x.org/", "2024-06-01", True), ("http://www.x.org/", "2024-06-01", False), ("http://a.shop.net/pills/1", "2024-06-01", True),
        ("http://a.shop.net/toys", "2024-06-01", False), ("http://tie.com/", "2024-01-02", False), (None, "2024-06-01", False),
        ("not a url", "2024-06-01", False), ("http://bad.com/", None, False), ("http://" + "a." * 200 + "bad.com/", "2024-03-11", False),
        ("http://bad.com/a", "2024-01-10", True),
    ]
    got = judged(spark, [c[:2] for c in cases])
    assert [got[i].blocked for i in range(len(cases))] == [c[2] for c in cases]


def test_most_specific_category(spark):
    got = judged(spark, [("http://a.deep.bad.com/", "2024-03-20"), ("http://bad.com/", "2024-03-20")])
    assert (got[0].category, got[0].n_active) == ("phishing", 2) and (got[1].category, got[1].n_active) == ("malware", 1)


def test_empty(spark):
    caps = spark.createDataFrame([(1, "http://bad.com/", datetime(2024, 1, 20))], "page_id long, url string, fetched_at timestamp")
    log = uf.entries(spark, LOG)
    assert uf.judge(caps, log.limit(0)).first().blocked is False
    assert uf.judge(caps.limit(0), log).count() == 0
    assert uf.judge(caps, log.withColumn("host", F.lit(None).cast("string"))).first().blocked is False
