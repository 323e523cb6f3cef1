"""Claim-level ladders over joined tables: citations, sufficiency, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation_label(*, cited: Column, phantom: Column, contradicted: Column, exact: Column, partial: Column, uncited_support: Column, doc_precise: Column, doc_overlap: Column, elsewhere: Column, unsupported: Column) -> Column:
    """The first rung that holds of a claim's citations."""
    return (
        F.when(~cited, "missing")
        .when(phantom, "phantom")
        .when(contradicted, "contradicted")
        .when(exact, "full")
        .when(partial, "partial")
        .when(uncited_support, "unsupported")
        .when(doc_precise, "full")
        .when(doc_overlap, "partial")
        .when(elsewhere, "unsupported")
        .when(unsupported, "unsupported")
        .otherwise("unknown")
    )


def claim_rollup(claims: DataFrame, *, run="run_id", label="label", cited="cited", supporting="supporting") -> DataFrame:
    """Counts and rates of a run's claims in one pass."""
    n = lambda c: F.sum(c.cast("long"))
    out = claims.groupBy(run).agg(
        F.count(F.lit(1)).alias("n"), n(F.col(label) == "entailed").alias("entailed"), n(F.col(label) == "unsupported").alias("unsupported"), n(F.col(label) == "contradicted").alias("contradicted"),
        n((F.col(label) == "entailed") & F.arrays_overlap(cited, supporting)).alias("cited_support"),
    )
    rate = lambda a: F.round(F.try_divide(F.col(a).cast("double"), F.col("n")), 4)
    return out.withColumns({"entailed_rate": rate("entailed"), "unsupported_rate": rate("unsupported"), "contradicted_rate": rate("contradicted"), "citation_rate": F.round(F.try_divide(F.col("cited_support").cast("double"), F.col("entailed")), 4)})


def cause_score(n_support: Column, n_signals: Column, n_nodes: Column, n_against: Column, n_missing: Column) -> Column:
    """The score of a candidate cause from counts, between 0 and 1."""
    cap = lambda most, each, n: F.least(F.lit(most), F.lit(each) * n)
    s = cap(0.35, 0.15, n_support) + 0.25 + cap(0.20, 0.05, n_signals) + cap(0.10, 0.03, n_nodes) - cap(0.20, 0.10, n_against) - cap(0.20, 0.07, n_missing)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def causes(rows: DataFrame, *, run="run_id", cause="cause", score="score", least: float = 0.30) -> DataFrame:
    """The primary cause of each run, and the others of ``least`` or more in order."""
    ranked = rows.where(F.col(score) >= least).groupBy(run).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(cause).alias("c")))).alias("x"))
    names = F.transform("x", lambda r: r["c"])
    return ranked.select(run, names[0].alias("primary_cause"), F.slice(names, F.lit(2), F.greatest(F.size(names), F.lit(1))).alias("secondary_causes"))


def external_relevance(chunks: DataFrame, signals: DataFrame, *, run="run_id", chunk="chunk_id") -> DataFrame:
    """The last signal about each chunk, by its place."""
    each = signals.select(run, F.explode("affected_chunk_ids").alias(chunk), "label", "pos")
    last = each.groupBy(run, chunk).agg(F.max_by("label", "pos").alias("external_label"))
    return chunks.join(last, [run, chunk], "left")


def union_of_results(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
