import random
import re

from pyspark.sql import functions as F

from plumbline.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, list(order)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return target


def test_budgets_are_met(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 7}" if i % 11 else None) for i in range(900)] + [(i, "w " * 9, "hot") for i in range(900, 2500)]
    rows += [(None, "a b", "s1"), (5, None, "s2"), (7, "", "only empty"), (9, "x  y\tz\x0bv\x1cu", "odd"), (9, "x  y\tz\x0bv\x1cu", "odd")]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs.withColumn("target", F.lit("clash")), mixing.word_count(F.col("text")), rows_per_range=100)
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert n == int(want[s] + 1e-9)
    again = mixing.mix(docs.repartition(7), mixing.word_count(F.col("text")), rows_per_range=100)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
    words = mixing.materialised(mixed, docs.columns).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(taken.values())


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), mixing.word_count(F.col("text"))).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], SCHEMA), mixing.word_count(F.col("text")))
    assert [(r.size, r.taken, r.target) for r in blank.collect()] == [(0, 0, 0.0)] * 2


def test_cut_keeps_whole_words(spark):
    mixed = spark.createDataFrame([(1, " one  two\nthree ", 3, 8), (2, "x", 1, 0)], "doc_id long, text string, size long, taken long")
    rows = [r.text for r in mixing.materialised(mixed, ["doc_id", "text"]).collect()]
    assert sorted(rows) == sorted([" one  two\nthree "] * 2 + [" one  two"])


def test_cuts_give_what_the_mix_takes(spark):
    """Taking rows by their sources' cuts equals the mix, but for rows alike at a cut, which share its words."""
    rng = random.Random(9)
    rows = [(i, f"s{i % 3}" if i % 3 else None, rng.randint(0, 40)) for i in range(400)] + [(None, "s1", 7)] * 5 + [(7, "s1", 3), (7, "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, words long")
    mixed = mixing.mix(docs, F.col("words"), rows_per_range=32)
    taken = mixing.applied(docs, F.col("words"), mixing.cuts(mixed))
    assert taken.columns == [*docs.columns, "size", "taken"]
    want, got = ({(r.doc_id, r.source, r.size): r.s for r in x.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("s")).collect()} for x in (mixed, taken))
    assert want.keys() == got.keys()
    assert all(0 <= want[k] - got[k] < 7 for k in want) and sum(want[k] != got[k] for k in want) <= 3
    empty = docs.limit(0)
    assert mixing.applied(empty, F.col("words"), mixing.cuts(mixing.mix(empty, F.col("words")))).count() == 0
