"""How faithful citations are, claim by claim, as expressions over one run's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENT = 0.7
#: An answer's own citation signs, and figures.
MARKER = r"(?i)\[(?:c|doc\s*)(\d+)\]"
FIGURE = r"\d"


def markers(text: Column) -> Column:
    """Chunk signs in a text: "[c3]" and "[doc 3]" are c3."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda x: F.concat(F.lit("c"), x)))


def support_label(verdict: Column, docs: Column, cited: Column) -> Column:
    """The first rung that holds of a claim: missing, phantom, contradicted, full, partial, unsupported or unknown.

    ``verdict`` holds the places of supporting and contradicting chunks in ``docs``, the documents of the run's chunks.
    """
    of = lambda places: F.array_distinct(F.transform(places, lambda i: F.get(docs, i)))
    backing = of(verdict["supporting"])
    supported, by_cited = verdict["label"] == "entailed", F.array_intersect(cited, backing)
    # A document's citation is precise if only one chunk of it was retrieved.
    precise = F.forall(by_cited, lambda d: F.size(F.filter(docs, lambda x: x == d)) == 1)
    return (
        F.when(F.size(cited) == 0, "missing")
        .when(F.size(F.array_except(cited, docs)) > 0, "phantom")
        .when((verdict["label"] == "contradicted") & F.arrays_overlap(of(verdict["contradicting"]), cited), "contradicted")
        .when(supported & (F.size(by_cited) > 0) & precise, "full")
        .when(supported & (F.size(by_cited) > 0), "partial")
        .when(supported, "unsupported")
        .when(verdict["label"].isin("unsupported", "contradicted"), "unsupported")
        .otherwise("unknown")
    )


def faithfulness(labels: Column, answer: Column) -> Column:
    """(status, failure type, reason) of a run by the labels of its claims."""
    n = lambda v: F.size(F.filter(labels, lambda x: x == v))
    out = lambda status, failure, reason: F.struct(F.lit(status).alias("status"), F.lit(failure).cast("string").alias("failure_type"), F.lit(reason).cast("string").alias("reason"))
    explicit = answer.rlike(MARKER) & answer.rlike(FIGURE)
    return (
        F.when(F.size(labels) == 0, out("skip", None, None))
        .when(n("contradicted") > 0, out("fail", "CONTRADICTED_CLAIM", "cited_source_contradicts_claim"))
        .when(n("phantom") > 0, out("fail", "CITATION_MISMATCH", "phantom_citation"))
        .when((n("unsupported") > 0) & explicit, out("fail", "CITATION_MISMATCH", "related_non_supporting_citation"))
        .when(n("unsupported") > 0, out("warn", "CITATION_MISMATCH", "related_non_supporting_citation"))
        .when(n("missing") > 0, out("warn", "CITATION_MISMATCH", "citation_missing"))
        .otherwise(out("pass", None, None))
    )


def probe_status(verdict: Column, docs: Column, cited: Column) -> Column:
    """A claim's status in the probe of whether citations are relied on."""
    backing = F.transform(verdict["supporting"], lambda i: F.get(docs, i))
    entailed, any_ = verdict["label"] == "entailed", F.size(cited) > 0
    return (
        F.when(entailed & any_ & F.arrays_overlap(backing, cited), "citation_supported")
        .when(entailed & any_, "citation_mismatch")
        .when(entailed, "citation_missing")
        .when(any_, "unsupported_cited_claim")
        .otherwise("unsupported_no_citation")
    )


def probe(statuses: Column, cited: Column, confidence: Column, *, suspicious: int = 2) -> Column:
    """fail, warn, pass or skip: a mismatch or an unsupported cited claim fails, as do ``suspicious`` missing citations; answers without citations are judged only if confident."""
    n = lambda *v: F.size(F.filter(statuses, lambda x: x.isin(*v)))
    unsure = (F.size(cited) == 0) & (F.coalesce(confidence, F.lit(0.0)) < CONFIDENT)
    bad = n("citation_mismatch", "unsupported_cited_claim")
    return F.when((F.size(statuses) == 0) | unsure, "skip").when((bad > 0) | (n("citation_missing") >= suspicious), "fail").when(n("citation_missing") > 0, "warn").otherwise("pass")
