"""Structure checks of parsed documents and chunks: fractions and rules as aggregates over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(chunks: DataFrame, checks: dict[str, Column], *, by: str = "doc_id") -> DataFrame:
    """The share of each document's chunks for which each check holds."""
    return chunks.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c.cast("double")).alias(name) for name, c in checks.items()))


def metadata_findings(covered: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row for each document and share below its limit, the gravest first."""
    rows = [F.when(F.col(k) < v, F.struct(F.lit(k).alias("check"), F.col(k).alias("share"), F.lit(v).alias("least"))) for k, v in limits.items()]
    return covered.withColumn("x", F.explode(F.array_compact(F.array(*rows)))).select(*[c for c in covered.columns if c not in limits], "x.*")


def numeric_ratio(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.rlike(r"^[\d.,%$-]+$"))).cast("double"), F.size(words)), F.lit(0.0))


def row_width_share(text: Column, separator: str = "|") -> Column:
    """The share of lines that have the most frequent number of cells."""
    widths = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.replace(x, F.lit(separator), F.lit(""))))
    most = F.array_max(F.transform(F.array_distinct(widths), lambda w: F.size(F.filter(widths, lambda v: v == w))))
    return F.try_divide(most.cast("double"), F.size(widths))


def lost_tables(tables: DataFrame, chunks: DataFrame, *, table_id: str = "table_id", ids: str = "source_table_ids") -> DataFrame:
    """Tables that no chunk names."""
    named = chunks.select(F.explode(ids).alias(table_id)).distinct()
    return tables.join(named, table_id, "left_anti")


def flattened(text: Column) -> Column:
    """Inline list signs (three or more) or numbered items (four or more) in one line."""
    return (F.regexp_count(text, F.lit(r" [-*•] ")) >= 3) | (F.regexp_count(text, F.lit(r" \d+[.)] ")) >= 4)


def missing_items(query: Column, answer: Column) -> Column:
    """Of "all N items / steps / requirements" (1 to 20) the numbers that the answer lacks."""
    n = F.regexp_extract(query, r"(?i)\b(\d{1,2})\s+(?:requirements?|items?|steps?)\b", 1)
    count = F.when(n != "", n.cast("int"))
    have = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)(?:^|\s)(\d{1,2})[.)]"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(count.between(1, 20), F.array_except(F.sequence(F.lit(1), count), have)).otherwise(F.array().cast("array<int>"))


SEVERITY = ("fail", "warn", "info")


def by_severity(findings: DataFrame, *, by: list[str], severity: str = "severity") -> DataFrame:
    """Findings with their place among those of one document, the gravest first."""
    order = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col(severity))
    w = Window.partitionBy(*by).orderBy(F.when(order > 0, order).otherwise(len(SEVERITY) + 1), *(c for c in findings.columns if c not in by))
    return findings.withColumn("place", F.row_number().over(w))


def governance(docs: DataFrame, rules: list[tuple[str, str, str]], *, domain: str = "domain", metadata: str = "metadata") -> DataFrame:
    """One row for each field that a document's domain requires and its metadata lacks; ``rules`` are (domain, field, severity), a fixed list."""
    from plumbline.functions.metadata import value

    each = [F.when((F.col(domain) == d) & F.coalesce(F.trim(value(F.col(metadata), f)) == "", F.lit(True)), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"))) for d, f, s in rules]
    return docs.withColumn("x", F.explode(F.array_compact(F.array(*each)))).select(*[c for c in docs.columns if c != metadata], "x.field", "x.severity")


def ingestion_summary(findings: DataFrame, docs: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """How many documents pass, warn and fail by their gravest finding; documents without any pass."""
    worst = findings.groupBy(doc).agg(F.max((F.col("severity") == "fail").cast("int")).alias("f"), F.max((F.col("severity") == "warn").cast("int")).alias("w"))
    out = docs.select(doc).join(worst, doc, "left")
    status = F.when(F.col("f") == 1, "fail").when(F.col("w") == 1, "warn").otherwise("pass")
    return out.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def lint(profile: dict) -> list[str]:
    """What is wrong with a parser profile: unknown keys, shares outside [0, 1], names twice, a chunk's least size over its greatest."""
    known = {"name", "strategy", "metadata", "limits", "least_chars", "most_chars"}
    out = [f"unknown key: {k}" for k in sorted(set(profile) - known)]
    out += [f"missing key: {k}" for k in ("name", "strategy") if not profile.get(k)]
    out += [f"share out of range: {k}" for k, v in sorted((profile.get("limits") or {}).items()) if not 0 <= v <= 1]
    paths = [p for ps in (profile.get("metadata") or {}).values() for p in ps]
    out += [f"path twice: {p}" for p in sorted({p for p in paths if paths.count(p) > 1})]
    if profile.get("least_chars", 0) > profile.get("most_chars", float("inf")):
        out.append("least_chars over most_chars")
    return out
