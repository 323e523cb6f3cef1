"""Citations, freshness and validity: joins of what was cited and retrieved with what the corpus says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phantom_citations(cited: DataFrame, retrieved: DataFrame, *, run="run_id", doc="doc_id") -> DataFrame:
    """Cited documents that the run did not retrieve; order and duplicates stay."""
    return cited.join(retrieved.select(run, doc), [run, doc], "left_anti")


def cited_status(chunks: DataFrame, cited: DataFrame, *, run="run_id", doc="doc_id") -> DataFrame:
    """cited, uncited, or unknown in runs that cite nothing."""
    hit = cited.select(run, doc).distinct().withColumn("hit", F.lit(True))
    any_ = cited.select(run).distinct().withColumn("any_cited", F.lit(True))
    out = chunks.join(hit, [run, doc], "left").join(any_, run, "left")
    return out.withColumn("cited_status", F.when(F.col("any_cited").isNull(), "unknown").when(F.col("hit"), "cited").otherwise("uncited")).drop("hit", "any_cited")


def last_entry(corpus: DataFrame, *, keys: list[str], pos: str) -> DataFrame:
    """One row a key, the one with the highest place: later entries overwrite earlier ones."""
    rest = [c for c in corpus.columns if c not in keys]
    last = F.max_by(F.struct(*rest), pos).alias("x")
    return corpus.groupBy(*keys).agg(last).select(*keys, "x.*")


def freshness(docs: DataFrame, as_of: Column, *, at="timestamp", max_age_days: int = 180) -> DataFrame:
    """``age_days`` (whole days) and ``freshness``: stale if older than the limit, unknown without a time."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros(at)) / F.lit(86_400_000_000))
    status = F.when(F.col(at).isNull(), "unknown").when(F.col(at) < as_of - F.make_dt_interval(F.lit(max_age_days)), "stale").otherwise("fresh")
    return docs.withColumn("age_days", age).withColumn("freshness", status)


def newer_alternative(rows: DataFrame, *, run="run_id", at="date") -> DataFrame:
    """Rows of a run that has a later dated row: a window instead of an inequality join."""
    return rows.withColumn("newest", F.max(at).over(Window.partitionBy(run))).where(F.col(at) < F.col("newest"))


def aligned_vs_newest(rows: DataFrame, *, run="run_id", at="date", score="score", rank="rank", days: int = 30) -> DataFrame:
    """Runs whose best aligned row is ``days`` or more older than their newest row; ties go to the first rank."""
    row = F.struct(rank, at, score)
    out = rows.where(F.col(at).isNotNull()).groupBy(run).agg(
        F.max_by(row, F.struct(F.col(score), -F.col(rank))).alias("used"), F.max_by(row, F.struct(F.unix_micros(F.col(at).cast("timestamp")), -F.col(rank))).alias("newest")
    )
    gap = F.datediff(F.col(f"newest.{at}"), F.col(f"used.{at}"))
    return out.select(run, F.col(f"used.{rank}").alias("used_rank"), F.col(f"newest.{rank}").alias("newest_rank"), gap.alias("gap_days")).where(F.col("gap_days") >= days)


def validity(*, withdrawn, superseded, replaced, deprecated, expiry, effective, amended, applicable, status, at, query_date, as_of, max_age_days: int = 180) -> Column:
    """The first rung that holds for a document, given as columns."""
    return (
        F.when(withdrawn, "withdrawn")
        .when(superseded, "superseded")
        .when(replaced, "replaced")
        .when(deprecated, "deprecated")
        .when(query_date > expiry, "expired")
        .when(query_date < effective, "not_yet_effective")
        .when(amended, "amended")
        .when(~applicable, "applicability_unknown")
        .when(status == "draft", "draft")
        .when(status.isin("active", "current"), "active")
        .when(status == "stale", "stale")
        .when(at.isNull(), "metadata_missing")
        .when(at < F.date_sub(as_of, max_age_days), "stale_by_age")
        .otherwise("active")
    )
