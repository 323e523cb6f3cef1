"""Numbered texts as trees of nodes, and what chunks keep of them.

Markers ("1.", "(A)", "(1)", "(ii)", "(a)", "a)"), titles of tables, and lines that end the body are
events, each with the lines up to the next event. Lines are shuffled once, by document. A marker's depth follows from its kind and the kind of the marker
before it; its parent is the nearest earlier marker of lower depth in the same section, which is the greatest of the last places of each lower
depth, so windows over the events do it and no stack is kept.

Null and empty texts have no nodes; the body begins after the first line ORDER or NOTIFICATION, or with the text where there is none; lines of a
table (from its title to the next top-level marker or end) belong to no node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.tables import once, with_strategy

# How lines begin.
BODY = r"(?i)^(ORDER:?$|NOTIFICATION\b)"
TABLE_TITLE = r"^(Statement|Annexure|ANNEXURE)\b"
ENDS = r"(?i)^(to,?$|copy to\b|\(by order\b|by order\b|//|sf/sc)"
MARKERS = (("top", r"^([0-9]+)\.\s*(.*)$"), ("upper", r"^(\([A-Z]+\))\s*(.*)$"), ("numeric", r"^(\([0-9]+\))\s*(.*)$"), ("roman", r"^(\([ivxlcdm]+\))\s*(.*)$"), ("alpha", r"^(\(?[a-z]\))\s*(.*)$"))
DEEPEST = 4
HEADINGS = r"(?i)\b(part\s+[ivxlcdm]+|chapter\s+[0-9]+|section\s+[0-9]+|rule\s+[0-9]+|annexure\s+[a-z0-9]+)\b"
CLAUSES = r"\([0-9]+\)|\b[0-9]+\.\s+[A-Z][A-Za-z]+"
LEAST_COVERAGE = 0.8


def lines_of(text: Column) -> Column:
    """A text's lines, white space folded, without empty ones."""
    folded = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(folded, lambda x: x != "")


def kind_of(line: Column) -> Column:
    out = F.when(line.rlike(TABLE_TITLE), "title").when(line.rlike(ENDS), "end")
    for name, pattern in MARKERS:
        out = out.when(line.rlike(pattern), name)
    return out.otherwise("")


def part_of(line: Column, kind: Column, group: int) -> Column:
    out = F
    for name, pattern in MARKERS:
        out = out.when(kind == name, F.regexp_extract(line, pattern, group))
    return out


def placed(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """One row a node: ``by``, ``pos`` (its line), ``above`` (places and labels of the nodes over it, from the root), ``depth``, ``kind``, ``label`` and ``text``.

    One shuffle of the lines by document serves all windows and the texts.
    """
    lines = docs.select(*by, F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    whole = Window.partitionBy(*by).orderBy("pos")
    begin = F.coalesce(F.min(F.when(F.col("line").rlike(BODY), F.col("pos"))).over(Window.partitionBy(*by)), F.lit(-1))
    body = lines.withColumn("begin", begin).where(F.col("pos") > F.col("begin")).withColumn("kind", kind_of(F.col("line")))
    # every line belongs to the last event up to it; an event is a marker, a table's title or an end
    body = body.withColumn("event", F.last(F.when(F.col("kind") != "", F.col("pos")), ignorenulls=True).over(whole)).where("event IS NOT NULL")
    said = F.when(F.col("kind") == "", F.col("line")).otherwise(F.nullif(part_of(F.col("line"), F.col("kind"), 2), F.lit("")))
    rows = body.groupBy(*by, F.col("event").alias("pos")).agg(
        F.max("kind").alias("kind"), F.max(part_of(F.col("line"), F.col("kind"), 1)).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), " ").alias("text")
    )
    whole = Window.partitionBy(*by).orderBy("pos")
    state = F.last(F.when(F.col("kind").isin("title", "end", "top"), F.col("kind")), ignorenulls=True).over(whole)
    rows = rows.select("*", (F.coalesce(state, F.lit("")) == "title").alias("in_table"), F.sum((F.col("kind") == "end").cast("int")).over(whole).alias("section"))
    rows = rows.where(~F.col("in_table") & ~F.col("kind").isin("title", "end"))
    own = Window.partitionBy(*by, "section").orderBy("pos")
    before = F.lag("kind").over(own)
    depth = (
        F.when(F.col("kind") == "top", 1).when(F.col("kind") == "upper", 2).when(F.col("kind") == "numeric", F.when(before == "upper", 3).otherwise(2))
        .when(F.col("kind") == "roman", F.when(before == "alpha", 4).otherwise(3)).otherwise(F.when(before == "numeric", 4).otherwise(3))
    )
    rows = rows.withColumn("depth", depth)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda d: F.last(F.when(F.col("depth") == d, F.struct("pos", "label")), ignorenulls=True).over(earlier)
    rows = rows.select("*", *(at(d).alias(f"d{d}") for d in range(1, DEEPEST)))
    # the last marker of a lower depth is an ancestor if no marker of a still lower one came after it
    line, reach = [], F.lit(-1)
    for d in range(1, DEEPEST):
        here = F.when((F.col("depth") > d) & (F.col(f"d{d}")["pos"] > reach), F.col(f"d{d}"))
        line.append(here)
        reach = F.greatest(reach, F.coalesce(F.when(F.col("depth") > d, F.col(f"d{d}")["pos"]), F.lit(-1)))
    return rows.select(*by, "pos", F.array_compact(F.array(*line)).alias("above"), "depth", "kind", "label", "text")


def nodes(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """One row a node: ``by``, ``pos`` (its line), ``parent_pos``, ``depth``, ``kind``, ``label``, ``path`` (labels from the root) and ``text``."""
    path = F.concat(F.transform("above", lambda a: a["label"]), F.array("label"))
    return placed(docs, *by, text=text).select(*by, "pos", F.try_element_at("above", F.lit(-1))["pos"].alias("parent_pos"), "depth", "kind", "label", path.alias("path"), "text")


def chunks(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """One chunk a node: ``by``, ``pos``, ``chunk`` (its text and that of all nodes below it, in document order) and ``n_nodes``.

    A node lies under ``DEEPEST`` - 1 others at most and knows them, so it goes to each of their chunks within the document's own task: no links are joined and nothing is shuffled again.
    """
    rows = placed(docs, *by, text=text)
    own = rows.select(*by, F.explode(F.concat(F.transform("above", lambda a: a["pos"]), F.array("pos"))).alias("top"), F.struct("pos", "text").alias("n"))
    out = own.groupBy(*by, F.col("top").alias("pos")).agg(F.array_sort(F.collect_list("n")).alias("x"))
    return out.select(*by, "pos", F.array_join(F.transform("x", lambda n: n["text"]), "\n").alias("chunk"), F.size("x").alias("n_nodes"))


def head(text: Column) -> Column:
    """An order's head: department, number, date as written, references (numbered lines before the body) and addressees (lines after "To")."""

    def read(lines: Column) -> Column:
        first = lambda p: F.get(F.filter(lines, lambda x: x.rlike(p)), 0)
        place = lambda p: F.array_min(F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(p), i))))
        dated, begin, read_, to = r"(?i)^(.+?)\s+Dated\s*:?\s*(.+)$", place(BODY), place(r"(?i)^Read the following"), place(r"(?i)^to,?$")
        between = lambda a, b: F.when(a.isNotNull() & (b > a + 1), F.slice(lines, a + 2, b - a - 1)).otherwise(F.array().cast("array<string>"))
        refs = F.filter(between(read_, F.coalesce(begin, F.size(lines))), lambda x: x.rlike("^[0-9]+[.)]"))
        return F.struct(
            F.regexp_replace(first(r"DEPARTMENT\s*$"), r"\s+DEPARTMENT\s*$", "").alias("department"), F.regexp_extract(first(dated), dated, 1).alias("number"), F.regexp_extract(first(dated), dated, 2).alias("dated"),
            F.transform(refs, lambda x: F.regexp_replace(x, r"^[0-9]+[.)]\s*", "")).alias("references"), between(to, F.size(lines)).alias("addressees"),
        )

    return once(lines_of(text), read)


# ---- what chunks keep --------------------------------------------------------------------------------------------


def section_paths(elements: DataFrame, *by: str, order: str = "pos", level: str = "level", label: str = "label") -> DataFrame:
    """Elements with the path of headings above them, carried forward: ``level`` is null for text and 1, 2, ... for headings, up to 6."""
    w = Window.partitionBy(*by).orderBy(order)
    at = lambda d: F.last(F.when(F.col(level) == d, F.struct(F.col(order).alias("o"), F.col(label).alias("l"))), ignorenulls=True).over(w)
    rows = elements.select("*", *(at(d).alias(f"__h{d}") for d in range(1, 7)))
    path, reach = [], F.lit(None).cast(elements.schema[order].dataType)
    for d in range(1, 7):
        here = F.col(f"__h{d}")
        path.append(F.when(reach.isNull() | (here["o"] > reach), here["l"]))
        reach = F.greatest(reach, here["o"])
    return rows.withColumn("path", F.array_compact(F.array(*path))).drop(*(f"__h{d}" for d in range(1, 7)))


def flattened(text: Column) -> Column:
    """How a hierarchy run into a chunk's text shows: distinct inline headings and numbered clauses."""
    inline = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HEADINGS), F.lit(1)), F.lower))
    return F.struct(F.size(inline).alias("headings"), F.regexp_count(text, F.lit(CLAUSES)).alias("clauses"))


def run_together(text: Column) -> Column:
    """Whether a text shows a hierarchy that was run together: three headings, four clauses, or a heading and three clauses."""
    return once(flattened(text), lambda f: (f["headings"] >= 3) | (f["clauses"] >= 4) | ((f["headings"] > 0) & (f["clauses"] >= 3)))


def hierarchy_findings(chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Findings on ``chunks`` (doc, chunk, text, path, strategy, sourced, crosses): hierarchies run into text, chunks over section bounds, and documents of which too few chunks have a path (null chunk)."""
    rows = with_strategy(chunks).withColumns({"f": flattened(F.coalesce("text", F.lit(""))), "bare": F.coalesce(F.size("path"), F.lit(0)) == 0})
    numbered = (F.col("f")["headings"] > 0) & (F.col("f")["clauses"] >= 3)
    shown = F.col("bare") & ~F.col("unchecked") & ((F.col("f")["headings"] >= 3) | (F.col("f")["clauses"] >= 4) | numbered)
    found = F.array_compact(F.array(
        F.when(shown, F.struct(F.lit("flattened_hierarchy").alias("check"), F.when(F.col("keeps_sections") & numbered, "fail").otherwise("warn").alias("severity"))),
        F.when(F.coalesce("crosses", F.lit(False)) & F.col("keeps_sections"), F.struct(F.lit("crosses_section").alias("check"), F.lit("warn").alias("severity"))),
    ))
    own = rows.select(doc, "chunk", F.explode(found).alias("x")).select(doc, "chunk", "x.*", F.lit(None).cast("double").alias("share"))
    share = rows.where("sourced AND keeps_sections").groupBy(doc).agg(F.avg(F.col("bare").cast("double")).alias("share"))
    less = share.where(F.col("share") > 1 - LEAST_COVERAGE + 1e-9).select(doc, F.lit(None).cast("string").alias("chunk"), F.lit("missing_paths").alias("check"), F.lit("warn").alias("severity"), "share")
    return own.unionByName(less)


def link_findings(nodes_: DataFrame, *, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Nodes whose parent is no node (``orphan``) and nodes on or below a cycle (``cycle``)."""
    from plumbline.operators.chunking import cyclic

    known = nodes_.select(F.col(node).alias("__up")).distinct()
    orphans = nodes_.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("__up"), "left_anti").select(node, F.lit("orphan").alias("check"))
    return orphans.unionByName(cyclic(nodes_, node=node, parent=parent).select(node, F.lit("cycle").alias("check")))
