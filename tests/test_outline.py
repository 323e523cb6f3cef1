import random
import re

from pyspark.sql import functions as F

from plumbline.operators import chunking
from plumbline.operators import outline as O

ORDER = """GENERAL ADMINISTRATION DEPARTMENT
G.O.Ms.No. 12 Dated: 3-4-2020
Read the following:
1. An older order
2) A letter
ORDER:
Preamble of no node.
1. First   point
goes on here
(A) Upper under one
(1) Third level
(a) Fourth level
(ii) Roman after alpha
2. Second
(1) Second level
(i) Third level, roman
Statement of posts
(1) not a node
x  y
3. After the table
b) lettered
To,
The Secretary
4. In a new section
(1) under four"""


def brute(text):
    """The nodes with a stack, line by line."""
    lines = [re.sub(r"\s+", " ", x).strip() for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    start = next((i for i, x in enumerate(lines) if re.search(O.BODY, x)), -1)
    out, stack, table, current = [], [], False, None
    for i, x in enumerate(lines):
        if i <= start:
            continue
        if re.search(O.TABLE_TITLE, x):
            table, current = True, None
            continue
        if re.search(O.ENDS, x):
            table, stack, current = False, [], None
            continue
        kind, m = next(((k, m) for k, p in O.MARKERS if (m := re.match(p, x))), ("", None))
        if table and kind != "top":
            continue
        table = False
        if not kind:
            if current:
                current["text"] = f"{current['text']} {x}".strip()
            continue
        last = stack[-1]["kind"] if stack else None
        depth = {"top": 1, "upper": 2, "numeric": 3 if last == "upper" else 2, "roman": 4 if last == "alpha" else 3, "alpha": 4 if last == "numeric" else 3}[kind]
        stack = [s for s in stack if s["depth"] < depth]
        current = {"pos": i, "parent": stack[-1]["pos"] if stack else None, "depth": depth, "kind": kind, "label": m[1], "path": [s["label"] for s in stack] + [m[1]], "text": m[2]}
        stack.append(current)
        out.append(current)
    return [(n["pos"], n["parent"], n["depth"], n["kind"], n["label"], n["path"], n["text"]) for n in out]


def parsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in O.nodes(df, "doc").orderBy("doc", "pos").collect():
        got[r.doc].append((r.pos, r.parent_pos, r.depth, r.kind, r.label, r.path, r.text))
    return got


def test_order(spark):
    got = parsed(spark, [ORDER, "", None, "no markers\nat all"])
    assert got[0] == brute(ORDER) and len(got[0]) == 12
    assert [n[5] for n in got[0][:5]] == [["1"], ["1", "(A)"], ["1", "(A)", "(1)"], ["1", "(A)", "(1)", "(a)"], ["1", "(A)", "(1)", "(ii)"]]
    assert got[0][0][6] == "First point goes on here"
    assert got[1] == got[2] == got[3] == []
    h = spark.createDataFrame([(ORDER,), ("",)], "t string").select(O.head(F.col("t")).alias("h")).collect()
    assert (h[0].h.department, h[0].h.number, h[0].h.dated, h[0].h.references) == ("GENERAL ADMINISTRATION", "G.O.Ms.No. 12", "3-4-2020", ["An older order", "A letter"])
    assert h[0].h.addressees[0] == "The Secretary" and h[1].h.department is None


def test_random_outlines(spark):
    rng = random.Random(4)
    line = lambda: rng.choice(["1. a", "2.", "(A) b", "(BC) c", "(1) d", "(12) e", "(ii) f", "(a) g", "b) h", "plain text", "Annexure I", "To", "x   y", "", "Copy to all", "12 monkeys"])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = parsed(spark, texts)
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_a_hundred_thousand_lines(spark):
    text = "\n".join(f"{i}. top" if i % 10 == 0 else f"({i}) sub" for i in range(100_000))
    rows = O.nodes(spark.createDataFrame([(1, text)], "doc int, text string"), "doc")
    assert rows.count() == 100_000 and rows.where("depth = 2 AND parent_pos <> pos - pos % 10").count() == 0


def test_paths_are_carried_forward(spark):
    rows = [(1, 0, None, "intro"), (1, 1, 1, "A"), (1, 2, None, "x"), (1, 3, 3, "A.0.1"), (1, 4, None, "y"), (1, 5, 2, "A.2"), (1, 6, None, "z"), (1, 7, 1, "B"), (1, 8, None, "w"), (2, 0, None, "other")]
    got = O.section_paths(spark.createDataFrame(rows, "doc int, pos int, level int, label string"), "doc").orderBy("doc", "pos").collect()
    assert [r.path for r in got] == [[], ["A"], ["A"], ["A", "A.0.1"], ["A", "A.0.1"], ["A", "A.2"], ["A", "A.2"], ["B"], ["B"], []]


def test_hierarchy_findings(spark):
    flat = "Chapter 1 says (1) a (2) b (3) c"
    rows = [
        (1, "c0", flat, [], "hierarchical", True, False), (1, "c1", "plain", ["A"], "hierarchical", True, True), (2, "c0", flat, [], "unknown", True, True), (3, "c0", flat, [], "summary", True, False),
        (4, "c0", flat, ["A"], "hierarchical", True, False), (5, "c0", "1. One 2. Two 3. Three 4. Four", None, "unknown", False, False), (6, "c0", "Section 1, section 1 and Part II", [], "unknown", True, None), (7, "c0", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id int, chunk string, text string, path array<string>, strategy string, sourced boolean, crosses boolean")
    got = sorted((r.doc_id, r.chunk or "", r.check, r.severity) for r in O.hierarchy_findings(df).collect())
    assert got == [(1, "", "missing_paths", "warn"), (1, "c0", "flattened_hierarchy", "fail"), (1, "c1", "crosses_section", "warn"), (2, "c0", "flattened_hierarchy", "warn"), (5, "c0", "flattened_hierarchy", "warn")]


def test_ancestors_of_deep_and_wide_trees(spark):
    deep = spark.range(1000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    pairs = chunking.ancestors(deep)
    assert pairs.count() == 1000 * 1001 // 2 and pairs.where("node - ancestor <> depth").count() == 0
    wide = spark.range(200_000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 50)).alias("parent_id"))
    assert chunking.descendants(wide).where("ancestor = 0").count() == 200_000


def test_orphans_and_cycles(spark):
    rows = [(1, None), (2, 1), (3, 99), (4, 5), (5, 6), (6, 4), (7, 4), (8, 8), (9, 3)]
    df = spark.createDataFrame(rows, "node_id long, parent_id long")
    assert sorted((r.node_id, r.check) for r in O.link_findings(df).collect()) == [(3, "orphan"), (4, "cycle"), (5, "cycle"), (6, "cycle"), (7, "cycle"), (8, "cycle")]
    got = sorted((r.node, r.ancestor, r.depth) for r in chunking.ancestors(df).collect())
    assert got == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 3, 0), (9, 3, 1), (9, 9, 0)]
    none = df.limit(0)
    assert chunking.ancestors(none).count() == 0 and O.link_findings(none).count() == 0


def test_chunks_hold_all_below(spark):
    """As by the parent links; every step stays in the document's own task."""
    rng = random.Random(5)
    line = lambda: rng.choice(["1. a", "2.", "(A) b", "(1) d", "(ii) f", "(a) g", "plain text", "Annexure I", "To", "12 monkeys"])
    docs = spark.createDataFrame([(i, "\n".join(line() for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(98, None), (99, "")], "doc int, text string")
    id_ = lambda c: F.col("doc") * 1000 + F.col(c)
    links = O.nodes(docs, "doc").select(id_("pos").alias("node_id"), id_("parent_pos").alias("parent_id"), "pos", "text")
    want = sorted((r.node_id, r.chunk, r.n_nodes) for r in chunking.hierarchical(links).collect())
    rows = O.chunks(docs, "doc")
    assert sorted((r.doc * 1000 + r.pos, r.chunk, r.n_nodes) for r in rows.collect()) == want and len(want) > 200
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_order_outlines_are_dealt_by_their_lines(spark, monkeypatch):
    import os

    import pytest

    from plumbline.plans import evidence

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    monkeypatch.setattr(evidence, "LINES_A_TASK", 100, raising=False)
    rows = O.nodes(evidence.order_outlines(spark, "/root/testdata/sf0.001"), "doc_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 40 and max(r["count"] for r in rows) < 400
