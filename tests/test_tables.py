import random

from pyspark.sql import functions as F

from plumbline.operators import tables as T


def scores(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return df.select("i", T.structure_score(F.col("t")).alias("s"), T.collapsed(F.col("t")).alias("c"), T.digit_share(F.col("t")).alias("d"), T.row_consistency(F.col("t")).alias("r")).orderBy("i").collect()


def test_structure_of_texts(spark):
    texts = ["| a | b |", "x <table> y", "a\tb", "a  b  c\nd  e  f\ng  h  i", "one two three\nfour five six\nseven eight nine ten", "plain", "", "Part Quantity Flag of this order are 1 2 R", "Part quantity Flag of this order are 1 2 R", "Part Quantity Flag\nof this order are 1 2 R"]
    got = scores(spark, texts)
    assert [r.s for r in got] == [1.0, 1.0, 0.2, 0.4, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.c for r in got] == [False] * 7 + [True, False, False]
    assert (got[7].d, got[6].d, round(got[4].r, 4)) == (0.2, 0.0, 0.6667)
    h = spark.createDataFrame([(["A", "b"], "has a only"), ([], "x"), (["zz"], "")], "h array<string>, t string").select(T.header_coverage(F.col("h"), F.col("t")).alias("x")).collect()
    assert [r.x for r in h] == [0.5, 1.0, 0.0]


def brute(text):
    lines, out, i = (text or "").split("\n"), [], 0
    import re

    kind = lambda x: "pipe" if re.search(T.PIPE, x) else "tab" if "\t" in x else "aligned" if re.search(T.ALIGNED, x) else ""
    while i < len(lines):
        j = i
        while kind(lines[i]) and j + 1 < len(lines) and kind(lines[j + 1]) == kind(lines[i]):
            j += 1
        if j > i:
            out.append((i, j, kind(lines[i])))
        i = j + 1
    return out


def test_blocks_are_islands(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["| a | b |", "|---|---|", "| 1 | 2 | 3 |", "a\tb", "1\t2", "x  y  z", "1  2  3", "plain text", ""])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 25))) for _ in range(50)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in T.blocks(df, "doc").orderBy("doc", "first").collect():
        got[r.doc].append((r.first, r.last, r.kind))
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    one = T.blocks(spark.createDataFrame([(1, "| Plan | Price |\n|---|---|\n| Basic | 5 |\n| Plus | 9 | x |")], "doc int, text string"), "doc").first()
    assert (one.n_rows, one.n_cols, round(one.width_share, 4), one.header) == (2, 2, 0.6667, ["plan", "price"])


def test_many_lines_in_one_text(spark):
    text = "\n".join("a  b  c" if i % 3 else "prose" for i in range(90_000))
    assert T.blocks(spark.createDataFrame([(1, text)], "doc int, text string"), "doc").count() == 30_000


def test_findings(spark):
    tables = [(1, "t", ["Part", "Flag"], "table_aware"), (2, "t", ["Part"], "table_aware"), (3, "t", ["Part"], "unknown"), (4, "t", ["Part"], "summary"), (5, "t", [], "table_aware"), (6, "t", ["Part", "Flag"], "table_aware"), (7, "t", None, "strange")]
    chunks = [
        (1, "c", "part 1 flag 2", ["t"], "table_aware"), (1, "d", "| x | y |", ["t", "t"], "table_aware"), (3, "c", "Part Quantity Flag of this order are 1 2 R", [], "unknown"), (4, "c", "1\n2\n3\n4", None, "summary"),
        (5, "c", "| a | b |", ["t"], "table_aware"), (6, "c", "| Part | Flag |", ["t"], "table_aware"), (8, "c", "1\n2\n3\n4", None, "fixed_token"), (9, "c", "Part Quantity Flag of this order are 1 2 R", [], "table_aware"), (10, "c", None, None, None),
    ]
    found = T.table_findings(spark.createDataFrame(tables, "doc_id int, table_id string, headers array<string>, strategy string"), spark.createDataFrame(chunks, "doc_id int, chunk string, text string, source_table_ids array<string>, strategy string"))
    got = sorted((r.doc_id, r.chunk or "", r.check, r.severity) for r in found.collect())
    assert got == [(1, "c", "weak_table", "fail"), (1, "d", "weak_table", "warn"), (2, "", "lost_table", "fail"), (3, "c", "collapsed_table", "warn"), (8, "c", "dense_numbers", "warn"), (9, "c", "collapsed_table", "fail")]
