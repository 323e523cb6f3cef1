"""Why a claim failed: candidate causes, their scores, the causal chain of the first failing node and a decision that never gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.grounding import cause_score
from plumbline.session import stored

CAUSE = "struct<cause:string,stage:string,score:double,evidence_for:array<string>,evidence_against:array<string>,fix:string,effect:string>"
GOVERNANCE = ("citation_mismatch", "stale_source_usage", "post_rationalized_citation")
STAGE_WEIGHT = {"GENERATION": 1.0, "GROUNDING": 0.8, "RETRIEVAL": 0.6, "SECURITY": 0.4}
#: (cause, stage, remedy, effect): fixed names.
CAUSES = {
    "insufficient_context_or_retrieval_miss": ("RETRIEVAL", "retrieve more or widen the corpus", "would_likely_fix"),
    "weak_or_ambiguous_evidence": ("GROUNDING", "filter noisy candidates before grounding", "would_partially_fix"),
    "generation_contradicted_retrieved_evidence": ("GENERATION", "take values from chunks only", "would_likely_fix"),
    "stale_source_usage": ("RETRIEVAL", "filter by date and prefer the newest version", "would_partially_fix"),
    "citation_mismatch": ("RETRIEVAL", "map citations to retrieved chunks", "would_partially_fix"),
    "post_rationalized_citation": ("GROUNDING", "perturb the cited source and see whether the answer changes", "would_partially_fix"),
    "verification_uncertainty": ("GROUNDING", "use a stronger verifier or ask a person", "unknown"),
    "adversarial_context": ("SECURITY", "take suspicious chunks out", "unknown"),
}
#: What a node's failure suggests: fixed names.
HYPOTHESES = {
    "parser_validity": "parser_or_ingestion_damage",
    "retrieval_coverage": "retrieval_coverage_gap",
    "retrieval_precision": "retrieval_noise_or_query_context_mismatch",
    "context_assembly": "conflicting_or_badly_assembled_context",
    "version_validity": "stale_or_invalid_source_usage",
    "claim_support": "generation_grounding_failure",
    "citation_support": "citation_support_failure",
    "answer_completeness": "answer_completeness_failure",
    "security_risk": "adversarial_or_unsafe_context",
    "query_understanding": "query_understanding_failure",
}


def candidate(name: str, holds: Column, for_: list[Column], against: list[Column], supporters: Column, missing: Column | int = 0) -> Column:
    """A cause, if it holds, with what speaks for and against it: columns of text that are null where they do not apply."""
    stage, fix, effect = CAUSES[name]
    pro, con = F.array_compact(F.array(*for_)).cast("array<string>"), F.array_compact(F.array(*against)).cast("array<string>")
    score = cause_score(F.size(pro), supporters, F.size(pro), F.size(con), F.lit(missing) if isinstance(missing, int) else missing)
    whole = F.struct(F.lit(name).alias("cause"), F.lit(stage).alias("stage"), F.round(score, 6).alias("score"), pro.alias("evidence_for"), con.alias("evidence_against"), F.lit(fix).alias("fix"), F.lit(effect).alias("effect"))
    return F.when(holds, whole.cast(CAUSE))


def causes_of(verdict: Column, *, insufficient: Column, missed: Column, noisy: Column, stale: Column, phantom: Column, post: Column, security: Column, mean: Column, n: Column) -> Column:
    """The causes that a failed claim of a run may have, the likeliest first. ``stale`` and the flags are of the run."""
    lit, when = F.lit, F.when
    unsupported, contradicted = verdict["label"] == "unsupported", verdict["label"] == "contradicted"
    backed, near = F.size(verdict["supporting"]) > 0, F.size(verdict["candidates"]) > 0
    low = when(mean < 0.6, "low retrieval scores")
    found = (
        candidate("insufficient_context_or_retrieval_miss", unsupported & ~backed & (insufficient | missed), [lit("no supporting chunk"), when(insufficient, "context is insufficient"), when(missed, "coverage failed"), low, when(n < 3, "few chunks")], [when(near, "candidates exist")], 2 + missed.cast("int")),
        candidate("weak_or_ambiguous_evidence", unsupported & near & ~backed & (noisy | (verdict["reason"] == "partial_support")), [lit("candidates without support"), when(noisy, "retrieval is noisy")], [when(insufficient, "context is insufficient")], 1 + noisy.cast("int")),
        candidate("generation_contradicted_retrieved_evidence", contradicted & ((F.size(verdict["contradicting"]) > 0) | (verdict["conflicts"] > 0)), [lit("the claim is contradicted"), when(F.size(verdict["contradicting"]) > 0, "chunks contradict it"), when(verdict["conflicts"] > 0, "values conflict")], [low], lit(1)),
        candidate("stale_source_usage", F.size(stale) > 0, [lit("stale sources"), F.array_join(stale, ", ")], [], lit(1)),
        candidate("citation_mismatch", F.size(phantom) > 0, [lit("phantom citations"), F.array_join(phantom, ", ")], [], lit(1)),
        candidate("post_rationalized_citation", post, [lit("citations do not carry the claims")], [], lit(1)),
        candidate("verification_uncertainty", F.coalesce(F.startswith(verdict["reason"], lit("error")), lit(False)), [lit("the verifier failed"), verdict["reason"]], [], lit(1)),
        candidate("adversarial_context", security, [lit("a security check failed")], [when(verdict["label"] == "entailed", "the claim is entailed")], lit(2)),
    )
    weight = F.create_map(*(F.lit(x) for kv in STAGE_WEIGHT.items() for x in kv))
    rank = lambda c: 0.6 * c["score"] + 0.2 * F.coalesce(F.element_at(weight, c["stage"]), F.lit(0.0)) + 0.1 * F.least(F.size(c["evidence_for"]) / 5, F.lit(1.0)) + 0.1 * F.least((1 + F.size(c["evidence_for"]) - F.size(c["evidence_against"])) / 5, F.lit(1.0))
    ordered = F.array_sort(F.transform(F.array_compact(F.array(*found)), lambda c: F.struct((-F.round(rank(c), 9)).alias("r"), c["cause"].alias("name"), c.alias("c"))))
    return F.transform(ordered, lambda x: x["c"])


def selected(causes: Column, *, least: float = 0.30) -> Column:
    """(primary, secondary): the likeliest cause and the others of ``least`` or more; beside a contradiction, causes of governance stay whatever their score."""
    first = F.get(causes, 0)
    also = F.filter(F.slice(causes, F.lit(2), F.greatest(F.size(causes), F.lit(1))), lambda c: (c["score"] >= least) | ((first["cause"] == "generation_contradicted_retrieved_evidence") & c["cause"].isin(*GOVERNANCE)))
    return F.struct(F.coalesce(first["cause"], F.lit("unknown")).alias("primary_cause"), F.transform(also, lambda c: c["cause"]).alias("secondary_causes"), first["fix"].alias("fix"))


def pinpoint(nodes: Column, run_id: Column) -> Column:
    """Where the run first failed: at most one finding, with the node's status as its only evidence; nothing is calibrated, so a person reviews it."""
    failing = F.filter(nodes, lambda x: x["status"] == "fail")
    return F.transform(F.slice(failing, 1, 1), lambda x: F.struct(
        F.concat_ws("_", F.lit("finding"), x["node"], run_id).alias("finding_id"), x["node"].alias("node"), F.lit("uncalibrated").alias("calibration"), F.lit(True).alias("human_review"), F.lit(False).alias("gating"),
    ))


def chain(findings: Column) -> Column:
    """The hypothesis that the first finding's node suggests; at most one."""
    table = F.create_map(*(F.lit(x) for kv in HYPOTHESES.items() for x in kv))
    return F.transform(F.slice(findings, 1, 1), lambda f: F.struct(f["node"].alias("root"), F.coalesce(F.element_at(table, f["node"]), F.lit("unknown_upstream_failure")).alias("hypothesis")))

def trust(findings: Column, fallback: Column) -> Column:
    """warn, or human_review where fallback heuristics were used; null without findings. It never blocks."""
    decision = F.when(fallback, "human_review").otherwise("warn")
    return F.when(F.size(findings) > 0, F.struct(decision.alias("decision"), F.lit(False).alias("blocking"), F.lit(True).alias("human_review_required"), F.array(F.lit("calibration_unavailable"), F.lit("human_review_required")).alias("unmet")))


#: Reports that an attribution rests on, and where each stands in a diagnosis: of a claim, or of the run's analyzers.
REPORTS = ("verdict", "citation", "probe", "sufficiency", "staleness", "citations", "anomaly", "verifier")
OF_CLAIM = ("verdict", "citation", "probe")


def trace(diagnoses: DataFrame) -> DataFrame:
    """One row for each run, claim and report: what the report says, its stage, and where that comes from. Reports of the run stand beside each of its claims; a report that is not there is no row. The diagnosis is stored first, as its expressions are too large to stand in a filter once more."""
    claim = lambda c, name, value: F.struct(F.lit(name).alias("report"), value.alias("says"), F.lit("GROUNDING").alias("stage"), F.lit("claim").alias("of"))

    def rows(c: Column) -> Column:
        own = F.array(claim(c, "verdict", F.concat_ws(": ", c["label"], c["reason"])), claim(c, "citation", c["citation"]), claim(c, "probe", c["probe"]))
        runs = F.transform(F.filter("results", lambda r: r["analyzer"].isin(*[r_ for r_ in REPORTS if r_ not in OF_CLAIM])), lambda r: F.struct(r["analyzer"].alias("report"), F.concat_ws(": ", r["status"], r["failure_type"]).alias("says"), r["stage"].alias("stage"), F.lit("run").alias("of")))
        return F.filter(F.concat(own, runs), lambda x: x["says"].isNotNull())

    each = stored(diagnoses.select("run_id", "results", "claim_causes"), "diagnoses").select("run_id", "results", F.explode("claim_causes").alias("c"))
    return each.select("run_id", F.col("c.claim").alias("claim"), F.explode(rows(F.col("c"))).alias("x")).select("run_id", "claim", "x.*")


def attributed(diagnoses: DataFrame) -> DataFrame:
    """One row for each failed claim: its label, likeliest cause, the others and the remedy."""
    each = stored(diagnoses.select("run_id", "claim_causes"), "diagnoses").select("run_id", F.explode("claim_causes").alias("c")).where("c.causes IS NOT NULL")
    pick = selected(F.col("c.causes"))
    return each.select("run_id", F.col("c.claim").alias("claim"), F.col("c.text").alias("text"), F.col("c.label").alias("label"), pick["primary_cause"].alias("cause"), pick["secondary_causes"].alias("also"), pick["fix"].alias("fix"))
