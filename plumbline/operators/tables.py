"""Tables in texts: blocks of table lines, their headers and widths, and what a chunker did to the tables that the parser knew.

Blocks are islands of neighbouring lines of one kind; only lines that look like a table's are shuffled. Known tables meet chunks by an equality join on document and table id; strategies of chunkers are a fixed table of guarantees that is
joined as a small one.

Null and empty texts hold no blocks; an island of one line is no block; a table that no chunk names is lost, which counts where
the strategy promises provenance; tables without headers have full header coverage; strategies not in the table
promise nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIPE, ALIGNED, HTML = r"^\s*\|.+\|\s*$", r"^\S+(?:[ \t]{2,}\S+){2,}\s*$", r"(?i)<\s*(table|tr|td|th)\b"
RULE = r"^\s*\|[ \t:|-]+\|\s*$"
LEAST_STRUCTURE, LEAST_HEADERS, COLLAPSED, DENSE, ROWS_ALIKE = 0.7, 0.5, 0.3, 0.3, 0.6
#: What a chunker promises: (strategy, table structure, headers, source elements, flattening allowed, provenance, no checks of tables, section path, page, parent id).
STRATEGIES = (
    ("unknown", False, False, False, True, False, False, False, False, False),
    ("fixed_token", False, False, False, True, False, False, False, False, False),
    ("recursive_text", False, False, False, True, False, False, False, False, False),
    ("sentence", False, False, False, True, False, False, False, False, False),
    ("hierarchical", False, False, True, True, True, False, True, True, False),
    ("markdown_header", False, False, True, True, True, False, True, True, False),
    ("semantic", False, False, True, True, True, False, False, True, False),
    ("table_aware", True, True, True, False, True, False, False, True, False),
    ("parent_child", False, False, True, True, True, False, False, True, True),
    ("summary", False, False, False, True, True, True, False, True, False),
    ("late_chunking", False, False, True, True, True, False, False, True, False),
)
FLAGS = ("keeps_tables", "keeps_headers", "keeps_elements", "may_flatten", "needs_provenance", "unchecked", "keeps_sections", "needs_page", "needs_parent")
FINDING = ("check", "severity", "confidence")


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRATEGIES), "strategy string, " + ", ".join(f"{f} boolean" for f in FLAGS))


def with_strategy(rows: DataFrame) -> DataFrame:
    """``rows`` with their strategy's promises; ``strategy`` of another name promises nothing and lets tables be flattened."""
    out = rows.join(F.broadcast(strategies(rows.sparkSession)), "strategy", "left")
    return out.withColumns({f: F.coalesce(F.col(f), F.lit(f == "may_flatten")) for f in FLAGS})


def line_kind(line: Column) -> Column:
    return F.when(line.rlike(PIPE), "pipe").when(F.contains(line, F.lit("\t")), "tab").when(line.rlike(ALIGNED), "aligned").otherwise("")


def cells(line: Column, kind: Column) -> Column:
    """A table line's cells, trimmed."""
    inner = F.regexp_replace(line, r"^\s*\||\|\s*$", "")
    parts = F.when(kind == "pipe", F.split(inner, r"\|")).when(kind == "tab", F.split(line, "\t")).otherwise(F.split(F.trim(line), r"[ \t]{2,}"))
    return F.transform(parts, lambda c: F.trim(c))


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def blocks(texts: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """The table blocks of each row's text: ``by``, first, last (lines from 0), kind, n_rows, n_cols, width_share and header.

    Neighbouring table lines of one kind have the same difference of place and number among their kind. Only table lines are shuffled, by ``by`` and kind; the counts of widths keep
    that partitioning. The header is the first line if a rule follows it, or if it holds no digit and a later line does.
    """
    lines = texts.select(*by, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")).withColumn("kind", line_kind(F.col("line"))).where("kind <> ''")
    w = Window.partitionBy(*by, "kind").orderBy("pos")
    rows = lines.withColumn("island", F.col("pos") - F.row_number().over(w)).withColumns({"rule": F.col("line").rlike(RULE), "digit": F.col("line").rlike("[0-9]")})
    rows = rows.withColumn("width", F.when(~F.col("rule"), F.size(cells(F.col("line"), F.col("kind")))))
    two = F.slice(F.array_sort(F.collect_list(F.struct("pos", "line", "rule", "digit"))), 1, 2)
    part = rows.groupBy(*by, "kind", "island", "width").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("digit").alias("digit"), two.alias("top"))
    some = part.groupBy(*by, "kind", "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.when(F.col("width").isNotNull(), F.col("n"))).alias("body"), F.max(F.when(F.col("width").isNotNull(), F.struct("n", "width"))).alias("most"), F.max("digit").alias("digit"),
        F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, 2).alias("top"),
    ).where("last > first")
    one, ruled = F.col("top")[0], F.col("top")[1]["rule"]
    headed = (ruled | (~one["digit"] & F.col("digit"))) & ~one["rule"]
    header = F.when(headed, F.transform(cells(one["line"], F.col("kind")), lambda c: F.lower(c))).otherwise(F.array().cast("array<string>"))
    return some.select(
        *by, "first", "last", "kind", (F.coalesce("body", F.lit(0)) - headed.cast("int")).cast("int").alias("n_rows"), F.col("most")["width"].alias("n_cols"), (F.col("most")["n"] / F.col("body")).alias("width_share"), header.alias("header")
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def digit_share(text: Column) -> Column:
    """The share of a text's words that hold a digit."""
    return F.coalesce(once(words(text), lambda w: F.try_divide(F.size(F.filter(w, lambda x: x.rlike("[0-9]"))).cast("double"), F.size(w))), F.lit(0.0))


def row_consistency(text: Column) -> Column:
    """The share of the most frequent number of words among lines of three words or more; 0 with fewer than three such lines."""
    widths = F.filter(F.transform(F.split(text, "\n"), lambda x: F.size(words(x))), lambda n: n >= 3)
    share = lambda w: F.when(F.size(w) >= 3, F.array_max(F.transform(F.array_distinct(w), lambda v: F.size(F.filter(w, lambda u: u == v)))) / F.size(w)).otherwise(0.0)
    return once(widths, share)


def structure_score(text: Column) -> Column:
    """1 for pipes or table tags; else a fifth for each of tabs, two aligned lines and rows of one width."""
    aligned = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(ALIGNED))) >= 2
    some = F.contains(text, F.lit("\t")).cast("int") + aligned.cast("int") + (row_consistency(text) >= ROWS_ALIKE).cast("int")
    return F.when(text.rlike("(?m)" + PIPE) | text.rlike(HTML), 1.0).otherwise(some / 5.0)


def header_coverage(headers: Column, text: Column) -> Column:
    hits = F.size(F.filter(headers, lambda h: F.contains(F.lower(text), F.lower(h))))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(headers)), F.lit(1.0))


def collapsed(text: Column) -> Column:
    """A single line that begins with three capitalised names and goes on in names and numbers: a table run into one line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z./()-]*|[0-9]+(?:[.,][0-9]+)?"), F.lit(0))

    def looks(t: Column) -> Column:
        tail = F.slice(t, F.lit(4), F.greatest(F.size(t) - 3, F.lit(0)))
        numeric = lambda x: x.rlike("[0-9]")
        return (
            (F.size(t) >= 8) & (F.size(F.filter(t, numeric)) >= 2) & (F.size(F.filter(t, lambda x: x.rlike("[A-Za-z]"))) >= 6) & F.forall(F.slice(t, F.lit(1), F.lit(3)), lambda x: x.rlike("^[A-Z][^0-9]*$"))
            & F.exists(tail, numeric) & F.exists(tail, lambda x: x.rlike("[A-Za-z]"))
        )

    return (F.size(lines) == 1) & once(tokens, looks)


def finding(check: str, severity: Column | str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(check).alias("check"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"))


def known_table_findings(tables: DataFrame, chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Findings on tables that the parser reported: ``tables`` (doc, table_id, headers, strategy) against ``chunks`` (doc, chunk, text, source_table_ids).

    Lost tables have a null chunk; each chunk that names a table is judged by its structure and by how many of the headers it holds.
    """
    named = chunks.select(doc, "chunk", "text", F.explode(F.array_distinct("source_table_ids")).alias("table_id"))
    both = with_strategy(tables.where(F.col("table_id").isNotNull())).join(named, [doc, "table_id"], "left")
    text = F.coalesce("text", F.lit(""))
    both = both.withColumns({"structure": structure_score(text), "headed": header_coverage(F.col("headers"), text)})
    low, bare = F.col("structure") < LEAST_STRUCTURE, (F.size("headers") > 0) & (F.col("headed") < LEAST_HEADERS)
    clip = lambda x, a, b: F.least(F.lit(b), F.greatest(F.lit(a), x))
    lost = F.when(F.col("needs_provenance") | F.col("keeps_tables") | F.col("keeps_elements"), finding("lost_table", "fail", 0.9))
    weak = (
        F.when(F.col("keeps_tables"), F.when(low | (F.col("keeps_headers") & bare), finding("weak_table", F.when(low, "fail").otherwise("warn"), clip(1 - F.col("structure"), 0.7, 0.95))))
        .when(F.col("may_flatten"), F.when(F.col("keeps_headers") & bare, finding("weak_table", "warn", clip(1 - F.col("headed"), 0.6, 0.9))))
        .otherwise(F.when(low | (F.col("keeps_headers") & bare), finding("weak_table", "warn", clip(1 - F.col("structure"), 0.6, 0.9))))
    )
    found = F.when(~F.col("unchecked"), F.when(F.col("chunk").isNull(), lost).otherwise(weak))
    return both.withColumn("x", found).where("x IS NOT NULL").select(doc, "table_id", "chunk", *(F.col("x")[f].alias(f) for f in FINDING), "structure", "headed")


def text_finding(text: Column, may_flatten: Column) -> Column:
    """What a chunk without a table's id looks like: a collapsed table, dense numbers without structure, or null."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    shape = F.when(collapsed(text), "collapsed").when((digit_share(text) >= DENSE) & (lines >= 4), "dense")
    loose = F.when(shape.isNotNull(), structure_score(text) < COLLAPSED)
    found = lambda x: F.when(x["loose"] & (x["shape"] == "collapsed"), finding("collapsed_table", F.when(may_flatten, "warn").otherwise("fail"), 0.85)).when(x["loose"] & (x["shape"] == "dense"), finding("dense_numbers", "warn", 0.55))
    return once(F.struct(shape.alias("shape"), loose.alias("loose")), found)


def text_findings(chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """Findings on chunks that name no table: ``chunks`` (doc, chunk, text, source_table_ids, strategy)."""
    rows = with_strategy(chunks.where("coalesce(size(source_table_ids), 0) = 0")).where(~F.col("unchecked"))
    rows = rows.withColumn("x", text_finding(F.coalesce("text", F.lit("")), F.col("may_flatten"))).where("x IS NOT NULL")
    return rows.select(doc, F.lit(None).cast("string").alias("table_id"), "chunk", *(F.col("x")[f].alias(f) for f in FINDING), structure_score(F.col("text")).alias("structure"), F.lit(1.0).alias("headed"))


def table_findings(tables: DataFrame, chunks: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """All findings on tables: lost, weak, collapsed and dense ones."""
    return known_table_findings(tables, chunks.drop("strategy"), doc=doc).unionByName(text_findings(chunks, doc=doc))
