"""Diagnosis of runs: every analyzer is an expression over one nested row, so a diagnosis needs no shuffle.

``diagnose`` adds the analyzers' results as an array of structs, lets ``plans/policy.py`` decide which failure explains the
run, and derives stage, risk, confidence, causes and review from it. The plan is narrow: it reads, projects and writes, scales with the
files and runs unchanged on a stream. ``as_of`` is the time that ages are counted to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import metadata as M
from plumbline.functions import security
from plumbline.functions import taxonomy as X
from plumbline.functions import text as W
from plumbline.operators import attribution, citations, outline, requirements, sufficiency, tables, validity, verification
from plumbline.operators.documents import missing_items
from plumbline.plans import policy
from plumbline.plans.contract import REQUIRED, RESULT, Analyzer, Hooks, isolated, missing

UNSURE = r"(?i)\b(i am not sure|i'm not sure|unsure|uncertain|might be|may be|possibly|it is unclear|cannot determine|do not know|don't know)\b"
ABSTAIN = r"(?i)\b(cannot answer|can't answer|not enough (information|context)|no information|unable to (answer|determine))\b"

#: Turns of a conversation that one task takes, besides those that its first and last runs need.
SPAN = 256


def turn_windows(turns: DataFrame, chunks: int, span: int = SPAN) -> DataFrame:
    """Every turn with ``near``, the ``chunks`` turn numbers before it, and the next turn's role and text.

    A conversation is cut into spans of turns; a turn is also a row of the span that needs it as a chunk or as the next turn, and each span is ordered by itself. So
    a long conversation is many tasks' work, and arrays are bounded by ``chunks``.
    """
    at = lambda shift: F.floor((F.col("turn") + shift) / F.lit(span)).cast("long")
    rows = turns.select("conv_id", "turn", "role", "text", F.explode(F.array_distinct(F.array(at(0), at(chunks), at(-1)))).alias("span"))
    w = Window.partitionBy("conv_id", "span").orderBy("turn")
    near = F.collect_list(F.struct("turn", "role", "text")).over(w.rangeBetween(-chunks, -1))
    next_ = lambda c: F.lead(c).over(w)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv_id", "span").select("*", near.alias("near"), next_("role").alias("next_role"), next_("turn").alias("next_turn"), next_("text").alias("final_answer"))
    return rows.where(F.col("span") == at(0))


def conversation_runs(turns: DataFrame, chunks: int = 8) -> DataFrame:
    """Runs from a conversation table: a user's turn and its answer, with the assistant's turns among the ``chunks`` turns before it as retrieved chunks.

    The answer cites the last of them, and every fifth run cites a turn that is not there.
    """
    rows = turn_windows(turns, chunks)
    rows = rows.where("role = 'user' AND next_role = 'assistant' AND next_turn = turn + 1")
    chunk = lambda x: F.struct(
        F.concat_ws("-", "conv_id", x["turn"]).alias("chunk_id"), x["text"].alias("text"), F.concat(F.lit("doc"), x["turn"]).alias("source_doc_id"), F.lit(None).cast("double").alias("score"), F.expr("CAST(map() AS map<string,string>)").alias("metadata")
    )
    last = F.array_max(F.transform(F.filter("near", lambda x: x["role"] == "assistant"), lambda x: x["turn"]))
    cites = F.array_compact(F.array(F.when(last.isNotNull(), F.concat(F.lit("doc"), last)), F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0, F.concat(F.lit("doc"), F.col("turn") + 1000))))
    return rows.select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"), F.col("text").alias("query"), F.transform(F.filter("near", lambda x: x["role"] == "assistant"), chunk).alias("retrieved_chunks"), "final_answer",
        cites.alias("cited_doc_ids"),
        F.lit(None).cast("double").alias("answer_confidence"), F.expr("CAST(array() AS array<struct<doc_id:string,text:string,timestamp:timestamp,metadata:map<string,string>>>)").alias("corpus_entries"),
        F.expr("CAST(map() AS map<string,string>)").alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def result(at: int, name: str, weight: float, stage: str, status: Column, failure: Column, evidence: Column, score: Column | None = None, risk: Column | None = None, marks: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("analyzer"), F.lit(at).alias("at"), F.lit(weight).alias("weight"), status.alias("status"),
        F.when(status.isin("fail", "warn"), failure).alias("failure_type"), F.lit(stage).alias("stage"), (none if score is None else score).cast("double").alias("score"),
        (F.lit("NONE") if risk is None else risk).alias("security_risk"), F.when(status.isin("fail", "warn"), evidence).otherwise(F.array()).cast("array<string>").alias("evidence"),
        (F.array() if marks is None else F.array_compact(marks)).cast("array<string>").alias("marks"),
    ).cast(RESULT)


def pairs(n: Column, hit) -> Column:
    """Whether ``hit(i, j)`` holds for any two places i < j below n (a run's chunks are few)."""
    return F.exists(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i < n, F.exists(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: hit(i, j))).otherwise(False))


def with_features(runs: DataFrame, as_of: Column, check=verification.verify_whole, hooks: Hooks = Hooks()) -> DataFrame:
    """What many analyzers read, computed once a row. ``check`` is the verifier of claims."""
    chunks = F.coalesce("retrieved_chunks", F.expr("CAST(array() AS array<struct<chunk_id:string,text:string,source_doc_id:string,score:double,metadata:map<string,string>>>)"))
    entries = F.coalesce("corpus_entries", F.expr("CAST(array() AS array<struct<doc_id:string,text:string,timestamp:timestamp,metadata:map<string,string>>>)"))
    out = runs.withColumns({"chunks": chunks, "entries": entries, "cited": F.coalesce("cited_doc_ids", F.array().cast("array<string>")), "answer": F.coalesce("final_answer", F.lit(""))})
    out = out.withColumns(
        {
            "q": W.terms("query"),
            "answer_terms": W.terms("final_answer"),
            "chunk_terms": F.transform("chunks", lambda c: W.terms(c["text"])),
            "chunk_tokens": F.transform("chunks", lambda c: F.coalesce(W.tokens(c["text"]), F.array().cast("array<string>"))),
            "context": F.array_join(F.transform("chunks", lambda c: c["text"]), "\n"),
            "docs": F.transform("chunks", lambda c: c["source_doc_id"]),
            "scores": F.filter(F.transform("chunks", lambda c: c["score"]), lambda s: s.isNotNull()),
            "claims": F.filter(W.sentences("final_answer"), lambda s: (F.size(F.split(s, r"\s+")) >= 3) & ~s.rlike(ABSTAIN) & ~s.rlike(UNSURE) & ~s.rlike(W.ABSTENTION)),
        }
    )
    n = F.size("scores")
    mean = F.aggregate("scores", F.lit(0.0), lambda a, s: a + s) / F.greatest(n, F.lit(1))
    out = out.withColumn("ratios", F.transform("chunk_terms", lambda t: hooks.relevance(F.col("q"), t))).withColumn("mean", mean)
    spread = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda a, s: a + (s - F.col("mean")) * (s - F.col("mean"))) / F.greatest(n, F.lit(1)))
    known = F.array_distinct(F.filter("docs", lambda d: F.exists("entries", lambda e: e["doc_id"] == d)))
    entry = lambda d: F.try_element_at(F.filter("entries", lambda e: e["doc_id"] == d), F.lit(-1))  # noqa: E731  the last entry of a document counts
    return out.withColumns(
        {
            "spread": spread,
            "context_terms": F.array_distinct(F.flatten("chunk_terms")),
            "aged": F.filter(known, lambda d: hooks.stale(entry(d), as_of)),
            "dated": F.filter(F.transform("chunks", lambda c, i: F.struct(M.dated(c["metadata"])["date"].alias("date"), M.dated(c["metadata"])["key"].alias("key"), F.coalesce(W.overlap(F.array_distinct(W.tokens("answer")), F.array_distinct(W.tokens(c["text"]))), F.lit(0.0)).alias("fit"), i.alias("i"))), lambda x: x["date"].isNotNull()),
            "sources": validity.assessed(validity.sources(F.col("chunks"), F.col("cited"), F.col("entries")), as_of),
            "verdicts": verification.verified(F.col("claims"), F.transform("chunks", lambda c: c["text"]), check=check),
        }
    )


def fence(scores: Column) -> Column:
    """Q3 + 1.5 IQR by linear interpolation; 0.92 for fewer than three scores."""
    s = F.array_sort(scores)

    def quantile(p: float) -> Column:
        at = (F.size(s) - 1) * F.lit(p)
        low = F.floor(at).cast("int")
        return F.get(s, low) + (at - low) * (F.get(s, F.least(low + 1, F.size(s) - 1)) - F.get(s, low))

    return F.when(F.size(s) < 3, 0.92).otherwise(quantile(0.75) + 1.5 * (quantile(0.75) - quantile(0.25)))


def relative(dated: Column, days: int = 30) -> Column:
    """(used, newest): the dated chunk that the answer shares most with, and a newer one by ``days`` or more; null without both. Ties go to the first chunk."""
    used = F.get(F.array_sort(F.transform(dated, lambda x: F.struct((-x["fit"]).alias("f"), x["i"].alias("i"), x.alias("x")))), 0)["x"]
    newest = F.get(F.array_sort(F.transform(dated, lambda x: F.struct((-F.unix_date(x["date"])).alias("d"), x["i"].alias("i"), x.alias("x")))), 0)["x"]
    return F.when((F.size(dated) >= 2) & (used["fit"] > 0) & (F.datediff(newest["date"], used["date"]) >= days), F.struct(used.alias("used"), newest.alias("newest")))


def facts(hooks: Hooks = Hooks()) -> dict[str, Column]:
    """What several analyzers or several fields of one use, computed once a row."""
    n = F.size("chunks")
    labels = F.transform("verdicts", lambda v: v["label"])
    irrelevant, relevant = (F.size(F.filter("ratios", f)) for f in (lambda r: r == 0, lambda r: r >= 0.1))
    quoted = F.filter(F.regexp_extract_all("query", F.lit("""['"]([^'"]{3,80})['"]"""), F.lit(1)), lambda e: ~F.contains(F.lower("context"), F.lower(e)))
    coverage = F.coalesce(W.overlap(F.col("q"), F.col("context_terms")), F.lit(0.0))
    total = F.size("claims")
    count = lambda v: F.size(F.filter(labels, lambda x: x == v))
    near = pairs(n, lambda i, j: W.min_overlap(F.element_at("chunk_terms", i), F.element_at("chunk_terms", j)) > 0.85)
    z = F.exists("scores", lambda s: (F.size("scores") >= 2) & (F.col("spread") > 0) & ((s - F.col("mean")) / F.col("spread") > 2.0))
    top = F.reverse(F.array_sort("scores"))
    cliff = (F.size("scores") >= 2) & (F.get(top, 0) > 0.95) & (F.get(top, 1) < 0.5)
    injected = F.transform(F.filter("chunks", lambda c: security.injected(c["text"])), lambda c: c["chunk_id"])
    injected = F.array_distinct(F.concat(injected, security.split_over(F.col("chunks"))))
    steering = F.array_distinct(F.flatten(F.transform("chunks", lambda c: W.matches(c["text"], W.STEERING_ALL))))
    hard = F.arrays_overlap(steering, F.array(*map(F.lit, W.HARD_MARKERS))) | F.exists("chunks", lambda c: W.unlikely_tokens(c["text"]))
    everything = F.concat_ws("\n", "query", "final_answer", "context")
    conflict = pairs(n, lambda i, j: hooks.contradiction(F.element_at("chunk_tokens", i), F.element_at("chunk_tokens", j)))
    p = F.filter(F.array(*(count(v) / F.greatest(total, F.lit(1)) for v in ("entailed", "unsupported", "contradicted"))), lambda x: x > 0)
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log2(x))
    wants = F.col("query").rlike(sufficiency.CURRENT)
    return {
        "x_labels": labels, "x_irrelevant": irrelevant, "x_relevant": relevant, "x_quoted": quoted, "x_coverage": coverage, "x_phantom": F.array_except("cited", "docs"),
        "x_entailed": count("entailed"), "x_contradicted": count("contradicted"), "x_near": near, "x_injected": injected, "x_steering": steering,
        "x_hard": hard | F.exists("scores", lambda s: s > fence(F.col("scores"))), "x_private": W.privacy_request(F.col("query")) | W.medical_privacy(everything),
        "x_tables": F.filter(F.transform("chunks", lambda c: F.struct(c["chunk_id"].alias("chunk"), tables.text_finding(F.coalesce(c["text"], F.lit("")), F.lit(True))["check"].alias("check"))), lambda x: x["check"].isNotNull()),
        "x_flat": F.transform(F.filter("chunks", lambda c: outline.run_together(F.coalesce(c["text"], F.lit("")))), lambda c: c["chunk_id"]),
        "x_conflict": conflict, "x_entropy": entropy, "x_odd": z | cliff, "x_enough": sufficiency.sufficiency(F.col("query"), F.col("context"), F.col("answer")), "x_relative": relative(F.col("dated")),
        "x_citation": F.transform("verdicts", lambda v: citations.support_label(v, F.col("docs"), F.col("cited"))), "x_probe": F.transform("verdicts", lambda v: citations.probe_status(v, F.col("docs"), F.col("cited"))),
        **{f"x_{k}": c for k, c in validity.severity(F.col("sources"), F.col("docs"), F.col("cited"), F.col("query"), F.col("answer"), wants).items()},
    }


def analyzers() -> list[Column]:
    lit, when, col = F.lit, F.when, F.col
    n, total = F.size("chunks"), F.size("claims")
    has_query = F.size("q") > 0
    irrelevant, relevant, quoted, phantom, near, injected, steering, conflict, entropy = (col(f"x_{c}") for c in ("irrelevant", "relevant", "quoted", "phantom", "near", "injected", "steering", "conflict", "entropy"))
    hard, private, odd, enough = col("x_hard"), col("x_private"), col("x_odd"), col("x_enough")
    failed = total - col("x_entailed")
    bad = F.filter("verdicts", lambda v: v["label"] != "entailed")
    substantive = (F.length(F.trim("answer")) >= 80) & (F.regexp_count("answer", lit("[A-Za-z]{4,}")) >= 3) & ~col("answer").rlike(W.ABSTENTION) & ~col("answer").rlike(ABSTAIN) & ~col("answer").rlike(UNSURE)
    empty = (total == 0) & substantive & (n > 0)
    grounding = when(empty, "fail").when((total == 0) | (n == 0), "skip").when(failed / total >= 0.3, "fail").when(failed > 0, "warn").otherwise("pass")
    explicit = F.exists(bad, lambda v: (v["label"] == "contradicted") & (v["conflicts"] > 0))
    backed = F.exists(bad, lambda v: F.size(v["candidates"]) > 0)
    contra = failed == col("x_contradicted")
    grounds = F.array(
        when(backed, "candidate_backed"), when(backed & ~contra, "signal:candidate_backed_unsupported_claim"), when(explicit, "explicit_contradiction"), when(col("x_contradicted") > 0, "signal:grounding_contradiction"),
        when(F.exists(bad, lambda v: v["reason"] == "partial_support"), "partial_support"), when((col("x_contradicted") > 0) & contra & ~explicit, "inexplicit_grounding"),
    )
    stale_status = when((F.size("aged") > 0) | col("x_relative").isNotNull(), "fail").otherwise("pass")
    broken = pairs(n, lambda i, j: (j == i + 1) & (F.element_at("docs", i) == F.element_at("docs", j)) & ~F.element_at("chunks", i)["text"].rlike(r"[.!?:;]\s*$") & F.element_at("chunks", j)["text"].rlike(r"^\s*[a-z]"))
    return [
        result(1, "parser", 0.85, "PARSING", when(broken | (F.size("x_tables") > 0) | (F.size("x_flat") > 0), "warn").otherwise("pass"),
               when(F.size("x_tables") > 0, "TABLE_STRUCTURE_LOSS").when(F.size("x_flat") > 0, "HIERARCHY_FLATTENING").otherwise("CHUNKING_BOUNDARY_ERROR"),
               when(F.size("x_tables") > 0, F.transform("x_tables", lambda x: F.concat_ws(": ", x["chunk"], x["check"]))).when(F.size("x_flat") > 0, F.transform("x_flat", lambda c: F.concat(c, lit(": a hierarchy run into text")))).otherwise(F.array(lit("a chunk breaks off inside a sentence")))),
        result(2, "sufficiency", 0.9, "SUFFICIENCY", when(n == 0, "fail").otherwise(enough["status"]), when(n == 0, "INSUFFICIENT_CONTEXT").otherwise(enough["failure_type"]), F.array(F.concat(enough["reason"], lit(", coverage "), F.round(col("x_coverage"), 4).cast("string"))), col("x_coverage"),
               None, F.array(when((n > 0) & enough["reason"].isin(*sufficiency.STRUCTURED), F.concat(lit("sufficiency:"), enough["reason"])), when(n == 0, "missing_context"), when((n > 0) & (enough["reason"] == "low_coverage"), "signal:term_coverage_fallback"))),
        result(3, "grounding", 0.9, "GROUNDING", grounding, when(empty, "CLAIM_EXTRACTION_FAILED").when(contra, "CONTRADICTED_CLAIM").otherwise("UNSUPPORTED_CLAIM"), when(empty, F.array(lit("no claims in a substantive answer"))).otherwise(F.transform(F.filter(F.arrays_zip("claims", "x_labels"), lambda x: x["x_labels"] != "entailed"), lambda x: F.concat_ws(": ", x["x_labels"], x["claims"]))), col("x_entailed") / F.greatest(total, lit(1)), None, grounds),
        result(5, "scope", 0.75, "RETRIEVAL", when((n == 0) | ~has_query, "skip").when(F.size(quoted) > 0, "fail").when(irrelevant == n, "fail").when(irrelevant > relevant, "warn").otherwise("pass"), lit("SCOPE_VIOLATION"), F.concat(F.transform(quoted, lambda e: F.concat(lit("quoted query entity missing: "), e)), F.array(F.concat_ws(" ", lit("irrelevant"), irrelevant.cast("string")))),
               None, None, F.array(when(F.size(quoted) > 0, "quoted_entity"), when(F.size(quoted) == 0, "lexical"))),
        result(6, "staleness", 0.95, "RETRIEVAL", stale_status, lit("STALE_RETRIEVAL"), when(F.size("aged") > 0, col("aged")).otherwise(F.array(F.concat(lit("the answer follows chunk "), col("x_relative")["used"]["i"].cast("string"), lit(" of "), col("x_relative")["used"]["date"].cast("string"), lit(", chunk "), col("x_relative")["newest"]["i"].cast("string"), lit(" is of "), col("x_relative")["newest"]["date"].cast("string"))))),
        result(7, "citations", 1.0, "RETRIEVAL", when(F.size("cited") == 0, "skip").when(F.size(phantom) > 0, "fail").otherwise("pass"), lit("CITATION_MISMATCH"), phantom, None, None, F.array(when(F.size(phantom) > 0, "reason:phantom_citation"))),
        result(8, "inconsistency", 0.5, "RETRIEVAL", when(conflict, "warn").otherwise("pass"), lit("INCONSISTENT_CHUNKS"), F.array(lit("chunks with shared terms differ in negation"))),
        result(14, "anomaly", 0.7, "RETRIEVAL", when(near, "fail").when(odd, "warn").otherwise("pass"), lit("RETRIEVAL_ANOMALY"), F.array(when(near, "near-duplicate chunks").otherwise("score outlier")), None, None, F.array(when(near, "explicit_anomaly"))),
        result(15, "injection", 1.0, "SECURITY", when(F.size(injected) > 0, "fail").otherwise("pass"), lit("PROMPT_INJECTION"), injected, None, when(F.size(injected) > 0, "HIGH").otherwise("NONE")),
        result(16, "poisoning", 0.95, "SECURITY", when((F.size(steering) > 0) & hard, "fail").when(F.size(steering) > 0, "warn").otherwise("pass"), lit("SUSPICIOUS_CHUNK"), steering, None, when((F.size(steering) > 0) & hard, "HIGH").when(F.size(steering) > 0, "LOW").otherwise("NONE")),
        result(17, "privacy", 1.0, "SECURITY", when(private, "fail").otherwise("pass"), lit("PRIVACY_VIOLATION"), F.array(lit("the query asks for a person's data")), None, when(private, "MEDIUM").otherwise("NONE")),
        result(19, "uncertainty", 1.0, "CONFIDENCE", when(col("final_answer").rlike(UNSURE), "fail").when(total == 0, "skip").when(entropy < 0.5, "pass").when(entropy <= 1.2, "warn").otherwise("fail"), lit("LOW_CONFIDENCE"), F.array(F.concat(when(col("final_answer").rlike(UNSURE), "text-only uncertainty, ").otherwise(""), lit("entropy "), F.round(entropy, 4).cast("string"))), entropy,
               None, F.array(when(col("final_answer").rlike(UNSURE), "text_uncertainty"))),
    ]


NODES = ("query_understanding", "parser_validity", "retrieval_coverage", "retrieval_precision", "context_assembly", "version_validity", "claim_support", "citation_support", "answer_completeness", "security_risk")


def of_result(name: str) -> Column:
    """An analyzer's result among the first results."""
    return F.get(F.filter("results", lambda r: r["analyzer"] == name), 0)


def status_of(name: str) -> Column:
    return of_result(name)["status"]


def later_facts() -> dict[str, Column]:
    """What the analyzers that read others' results use."""
    n = F.size("chunks")
    return {
        "y_faithful": citations.faithfulness(F.when(n > 0, F.col("x_citation")).otherwise(F.array().cast("array<string>")), F.col("answer")),
        "y_probe": F.when(n == 0, "skip").otherwise(citations.probe(F.col("x_probe"), F.col("cited"), F.col("answer_confidence"))),
        "y_affected": F.when((F.size(F.array_distinct("docs")) > 1) & (F.size("cited") > 0), F.array_except("x_retrieved_stale", "cited")).when(F.size(F.array_distinct("docs")) > 1, F.col("x_retrieved_stale")).otherwise(F.array().cast("array<string>")),
        "y_noise": F.try_divide(F.col("x_irrelevant").cast("double"), n),
        "y_missing": missing_items(F.col("query"), F.col("final_answer")),
        "y_drift": requirements.drift(F.coalesce("q", F.array().cast("array<string>")), F.col("context_terms")),
        "y_score": F.least(F.greatest(F.lit(1.0) - F.when(F.col("mean") < 0.5, 0.1).otherwise(0.0) * (F.size("scores") > 0).cast("int") - F.aggregate("results", F.lit(0.0), lambda a, r: a + F.when(r["status"] == "fail", F.when(r["security_risk"] == "HIGH", 0.2).otherwise(0.1)).when(r["status"] == "warn", 0.05).otherwise(0.0)), F.lit(0.0)), F.lit(1.0)),
        "y_sure": F.col("final_answer").rlike(r"(?i)\b(definitely|certainly|without doubt|guaranteed|always)\b"),
    }


def later_analyzers() -> list[Column]:
    lit, when, col = F.lit, F.when, F.col
    n = F.size("chunks")
    faithful, probe = col("y_faithful"), col("y_probe")
    size = lambda c: F.size(col(c))
    grave = (size("x_cited_invalid") > 0) | (size("x_answer_bearing") > 0)
    unsupported = F.exists("verdicts", lambda v: v["label"] != "entailed")
    short = F.coalesce(status_of("sufficiency") == "fail", lit(False)) & (of_result("sufficiency")["failure_type"] == "INSUFFICIENT_CONTEXT")
    noisy = when((col("y_noise") >= 0.9) & (col("x_irrelevant") >= 5), "fail").when((col("y_noise") >= 0.5) & (col("x_irrelevant") >= 2), "warn")
    # The first rung that holds of a retrieval: (status, failure type, reason).
    rung = lambda status, failure, reason: F.struct(status if isinstance(status, Column) else lit(status), lit(failure), lit(reason))
    ladder = (
        (n == 0, rung("fail", "INSUFFICIENT_CONTEXT", "no chunks")),
        (size("x_cited_invalid") > 0, rung("fail", "STALE_RETRIEVAL", "cited sources are invalid")),
        (size("x_answer_bearing") > 0, rung("fail", "STALE_RETRIEVAL", "the answer rests on invalid sources")),
        (size("y_affected") > 0, rung("fail", "STALE_RETRIEVAL", "stale sources crowd the ranking")),
        (size("x_invalid_here") > 0, rung("warn", "STALE_RETRIEVAL", "invalid sources were retrieved")),
        (size("x_phantom") > 0, rung("fail", "CITATION_MISMATCH", "cited sources were not retrieved")),
        (F.array_contains("x_citation", "missing") & ~short, rung("warn", "CITATION_MISMATCH", "claims lack citations")),
        (unsupported & short & (size("cited") == 0), rung("fail", "INSUFFICIENT_CONTEXT", "context and claims lack evidence")),
        (~unsupported & short, rung("fail", "INSUFFICIENT_CONTEXT", "context lacks what the query needs")),
        (noisy.isNotNull(), rung(noisy, "RETRIEVAL_ANOMALY", "most chunks are beside the point")),
        (unsupported & F.exists("verdicts", lambda v: (v["label"] != "entailed") & (F.size(v["candidates"]) > 0)) & (col("x_relevant") > 0) & (col("x_irrelevant") > 0), rung("warn", "RERANKER_FAILURE", "candidates without rank labels")),
    )
    found = F
    for condition, out in ladder:
        found = found.when(condition, out)
    found = found.otherwise(rung("pass", None, None)).cast("struct<status:string,failure:string,reason:string>")
    severity = F.array(when(size("x_cited_invalid") > 0, "severity:cited_invalid_source"), when(size("x_answer_bearing") > 0, "severity:answer_bearing_invalid_source"), when(~grave & (size("x_retrieved_stale") > 0), "severity:retrieved_only_stale_source"), when(grave, "strong"))
    mixed = F.array_contains("x_probe", "unsupported_cited_claim") & F.array_contains("x_probe", "citation_supported")
    return [
        result(4, "claim_sufficiency", 0.9, "SUFFICIENCY", when(F.size("claims") == 0, "skip").otherwise("pass"), lit("INSUFFICIENT_CONTEXT"), F.array(), F.try_divide(col("x_entailed").cast("double"), F.size("claims"))),
        result(9, "citation_faithfulness", 0.7, "GROUNDING", faithful["status"], faithful["failure_type"], F.array(faithful["reason"]), None, None, F.array(F.concat(lit("reason:"), faithful["reason"]), when((faithful["status"] == "warn") & (faithful["reason"] == "related_non_supporting_citation"), "related_non_supporting"), when((faithful["failure_type"] == "CONTRADICTED_CLAIM") & F.exists("verdicts", lambda v: v["conflicts"] > 0), "explicit_contradiction"))),
        result(10, "validity", 0.65, "RETRIEVAL", when(grave | (size("y_affected") > 0) | (size("x_invalid_here") > 0), "fail").when(F.exists("sources", lambda x: x["state"].isin("stale_by_age", "stale", "amended") & F.array_contains("docs", x["doc"])), "warn").otherwise("pass"), lit("STALE_RETRIEVAL"), F.transform(F.filter("sources", lambda x: x["state"] != "active"), lambda x: F.concat_ws(": ", x["doc"], x["state"])), None, None, severity),
        result(11, "retrieval", 0.7, "RETRIEVAL", found["status"], found["failure"], F.array(found["reason"]), None, None, F.concat(severity, F.array(lit("structured"), when(found["failure"] == "CITATION_MISMATCH", when(size("x_phantom") > 0, "reason:phantom_citation").otherwise("reason:citation_missing"))))),
        result(12, "citation_probe", 0.85, "GROUNDING", probe, lit("POST_RATIONALIZED_CITATION"), F.transform(F.filter(F.arrays_zip("claims", "x_probe"), lambda x: ~x["x_probe"].isin("citation_supported", "unsupported_no_citation")), lambda x: F.concat_ws(": ", x["x_probe"], x["claims"])), None, None, F.array(when(mixed, "mixed_attachment"))),
        result(21, "confidence", 1.0, "CONFIDENCE", when(col("y_score") < 0.4, "fail").when(col("y_score") < 0.6, "warn").otherwise("pass"), lit("LOW_CONFIDENCE"), F.array(F.concat(lit("score "), F.round("y_score", 2).cast("string"))), F.round("y_score", 2)),
        result(22, "depth", 0.98, "RETRIEVAL", when((shallow := (size("y_missing") > 0) & (F.size(missing_items(col("query"), col("context"))) > 0)) | (col("y_drift")["status"] == "fail"), "fail").otherwise("pass"), when(shallow, "RETRIEVAL_DEPTH_LIMIT").otherwise("SCOPE_VIOLATION"),
               when(shallow, F.transform("y_missing", lambda i: F.concat(lit("item "), i.cast("string")))).otherwise(F.array(F.concat(lit("missing scope terms: "), F.array_join(col("y_drift")["missing"], " "))))),
        result(23, "answer", 0.95, "GENERATION", when((size("y_missing") > 0) & (F.size(missing_items(col("query"), col("context"))) == 0), "fail").when(col("y_sure") & F.exists("scores", lambda s: s < 0.5), "warn").otherwise("pass"), lit("GENERATION_IGNORE"), F.transform("y_missing", lambda i: F.concat(lit("item "), i.cast("string")))),
    ]


def nodes() -> Column:
    """The verifier's nodes in order, each pass, uncertain, fail or skip, whatever fails before."""
    when = F.when
    three = lambda name: when(status_of(name) == "fail", "fail").when(status_of(name) == "warn", "uncertain").when(status_of(name) == "skip", "skip").otherwise("pass")
    kind = W.answer_type(F.col("query"), F.col("final_answer"))
    security_ = when(F.exists("results", lambda r: (r["stage"] == "SECURITY") & (r["status"] == "fail")), "fail").otherwise("pass")
    grave = (F.size("x_cited_invalid") > 0) | (F.size("x_answer_bearing") > 0) | (status_of("staleness") == "fail")
    found = (
        when(F.size("q") == 0, "fail").otherwise("pass"), three("parser"), when(F.size("chunks") == 0, "fail").otherwise(three("sufficiency")), three("scope"),
        when(F.col("x_near"), "fail").when(F.col("x_conflict"), "uncertain").otherwise("pass"), when(grave, "fail").when(F.size("x_doubtful") > 0, "uncertain").otherwise("pass"), three("grounding"), three("citations"),
        when((kind == "mismatch") | (F.size("y_missing") > 0), "fail").when(kind == "uncertain", "uncertain").otherwise("pass"), security_,
    )
    whole = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("node"), s.alias("status")) for i, (name, s) in enumerate(zip(NODES, found))))
    return whole


def up_to_first(whole: Column) -> Column:
    """The nodes up to the first that fails; where nothing was retrieved, a failing query does not end them."""
    stops = F.filter(whole, lambda x: (x["status"] == "fail") & ~((x["place"] == 0) & (F.size("chunks") == 0)))
    return F.when(F.size(stops) > 0, F.slice(whole, F.lit(1), F.get(stops, 0)["place"] + 1)).otherwise(whole)


def first_failing(nodes_: Column, whole: Column) -> Column:
    """The node to blame: damage by the parser, an explicit attack or an invalid source comes first wherever it stands, a phantom citation before symptoms of the context, then the order of the nodes."""
    failing, original = F.filter(whole, lambda x: x["status"] == "fail"), F.get(F.filter(nodes_, lambda x: x["status"] == "fail"), 0)["node"]
    named = lambda *names: F.get(F.filter(failing, lambda x: x["node"].isin(*names)), 0)["node"]
    cited = F.when((F.size("x_phantom") > 0) & original.isin("citation_support", "context_assembly", "retrieval_precision"), named("citation_support"))
    return F.coalesce(named("parser_validity"), named("security_risk"), named("version_validity"), cited, original)


#: The failure that a node stands for.
NODE_FAILURE = {
    "query_understanding": "INSUFFICIENT_CONTEXT", "parser_validity": "CHUNKING_BOUNDARY_ERROR", "retrieval_coverage": "INSUFFICIENT_CONTEXT", "retrieval_precision": "SCOPE_VIOLATION", "context_assembly": "RETRIEVAL_ANOMALY",
    "version_validity": "STALE_RETRIEVAL", "claim_support": "UNSUPPORTED_CLAIM", "citation_support": "CITATION_MISMATCH", "answer_completeness": "GENERATION_IGNORE", "security_risk": "PROMPT_INJECTION",
}


def verifier() -> Column:
    """The verifier as an analyzer: it fails with the node to blame, and lists the nodes that fail after it."""
    node, map_ = F.col("blamed"), F.create_map(*(F.lit(x) for kv in NODE_FAILURE.items() for x in kv))
    grounding, secure = of_result("grounding"), F.get(F.filter("results", lambda r: (r["stage"] == "SECURITY") & (r["status"] == "fail")), 0)
    failure = F.when((node == "claim_support") & (grounding["status"] == "fail"), grounding["failure_type"]).when(node == "security_risk", secure["failure_type"]).otherwise(F.element_at(map_, node))
    status = F.when(node.isNotNull(), "fail").when(F.exists("nodes", lambda x: x["status"] == "uncertain"), "warn").otherwise("pass")
    doubtful = F.get(F.filter("nodes", lambda x: x["status"] == "uncertain"), 0)["node"]
    after = F.transform(F.col("downstream"), lambda n: F.concat(F.lit("then "), n))
    marks = F.array(F.when(node == "claim_support", F.when(F.exists("verdicts", lambda v: (v["label"] == "contradicted") & (v["conflicts"] > 0)), "explicit_contradiction")))
    return result(13, "verifier", 0.6, "UNKNOWN", status, F.when(node.isNotNull(), failure), F.concat(F.array(F.coalesce(node, doubtful)), after), None, None, marks).withField("stage", F.coalesce(F.element_at(stage_of_node(), node), F.lit("UNKNOWN")))


def stage_of_node() -> Column:
    own = dict(zip(NODES, ("RETRIEVAL", "PARSING", "SUFFICIENCY", "RETRIEVAL", "RETRIEVAL", "RETRIEVAL", "GROUNDING", "GROUNDING", "GENERATION", "SECURITY")))
    return F.create_map(*(F.lit(x) for kv in own.items() for x in kv))


#: What to do about a failure.
REMEDY = {
    "STALE_RETRIEVAL": "refresh the index or filter by date", "SCOPE_VIOLATION": "check the query's preparation and the index", "CITATION_MISMATCH": "let answers cite retrieved documents only",
    "INCONSISTENT_CHUNKS": "look for contradictions among the chunks", "INSUFFICIENT_CONTEXT": "retrieve more or abstain", "UNSUPPORTED_CLAIM": "drop claims without evidence",
    "CONTRADICTED_CLAIM": "drop claims that the evidence denies", "PROMPT_INJECTION": "filter instructions from retrieved text", "SUSPICIOUS_CHUNK": "set the document aside and check its origin",
    "RETRIEVAL_ANOMALY": "look for duplicates and broken scores", "PRIVACY_VIOLATION": "refuse or redact", "LOW_CONFIDENCE": "abstain or ask a person", "CHUNKING_BOUNDARY_ERROR": "cut chunks at sentences and sections",
    "POST_RATIONALIZED_CITATION": "ask for quotations of the text used", "RETRIEVAL_DEPTH_LIMIT": "retrieve more candidates", "GENERATION_IGNORE": "tighten the grounding instructions", "CLEAN": "nothing to do",
}

CHAIN = "array<struct<root:string,hypothesis:string>>"


def diagnose(
    runs: DataFrame, *, as_of: str, check=verification.verify_whole, extra: tuple[Column, ...] = (), analyzers_: tuple[Analyzer, ...] = (), required=REQUIRED, hooks: Hooks = Hooks(), entailment_grade: bool = False, rules: tuple[policy.Rule, ...] = policy.RULES
) -> DataFrame:
    """``run_id`` and the diagnosis of each run: primary failure, stage, risk, confidence, results, causes and review.

    ``check`` verifies a claim by its run's texts, ``extra`` are analyzers of one's own as columns built by ``result``, ``analyzers_`` those in Python, each within its own error
    boundary, ``required`` the analyzers without which no run is clean, ``hooks`` shared judgements, ``rules`` the
    policy's. With ``entailment_grade`` the verifier is trusted to judge entailment, and an answer all of whose claims it entails clears weak failures of retrieval; the built-in one is lexical and is not. Runs without chunks, claims, citations or an answer have the verdicts of their empty lists; null text counts as empty.
    """
    if analyzers_:
        runs = runs.withColumn("own_results", isolated(analyzers_, runs.columns))
    own = F.col("own_results") if analyzers_ else F.array().cast(f"array<{RESULT}>")
    out = with_features(runs, F.lit(as_of).cast("timestamp"), check, hooks).withColumns(facts(hooks)).withColumn("results", F.concat(F.array(*analyzers(), *extra), own))
    out = out.withColumns(later_facts()).withColumns({"all_nodes": nodes(), "results": F.concat("results", F.array(*later_analyzers()))})
    out = out.withColumn("nodes", up_to_first(F.col("all_nodes"))).withColumn("blamed", first_failing(F.col("nodes"), F.col("all_nodes")))
    place = F.get(F.filter("all_nodes", lambda x: x["node"] == F.col("blamed")), 0)["place"]
    out = out.withColumn("downstream", F.transform(F.filter("all_nodes", lambda x: (x["status"] == "fail") & (x["place"] > place)), lambda x: x["node"]))
    out = out.withColumn("results", F.concat("results", F.array(verifier())))
    said = F.filter("results", lambda r: r["status"].isin("fail", "warn") & r["failure_type"].isNotNull() & (r["analyzer"] != "confidence"))
    candidates = F.transform(said, lambda r: F.struct(r["analyzer"], r["at"], r["weight"], r["status"], r["failure_type"], r["stage"], F.lit("uncalibrated").alias("calibration"), r["evidence"], r["marks"]))
    clean_claims = F.lit(entailment_grade) & (F.size("claims") > 0) & F.forall("verdicts", lambda v: v["label"] == "entailed")
    out = out.withColumn("run_marks", F.array_distinct(F.concat(F.flatten(F.transform("results", lambda r: r["marks"])), F.when(clean_claims, F.array(F.lit("entailment_clean"))).otherwise(F.array().cast("array<string>")))))
    out = policy.decide(out, candidates, F.col("run_marks"), rules)
    out = out.withColumn("missing_analyzers", missing(F.col("results"), required))
    warned = F.get(F.filter("results", lambda r: (r["status"] == "warn") & r["failure_type"].isin("RETRIEVAL_ANOMALY", "CHUNKING_BOUNDARY_ERROR")), 0)
    top = F.col("p_primary")
    failure = F.coalesce(top["failure_type"], F.when(F.size("missing_analyzers") > 0, F.lit("INCOMPLETE_DIAGNOSIS")), warned["failure_type"], F.lit("CLEAN"))
    out = out.withColumns({"failure": failure, "failing_stage": F.coalesce(top["stage"], warned["stage"], F.lit("UNKNOWN"))})
    failed = lambda name: F.exists("results", lambda r: (r["analyzer"] == name) & (r["status"] == "fail"))
    whole = F.arrays_zip(F.col("claims").alias("text"), F.col("verdicts").alias("v"), F.col("x_citation").alias("citation"), F.col("x_probe").alias("probe"))
    of_run = dict(
        insufficient=failed("sufficiency"), missed=F.exists("nodes", lambda x: (x["node"] == "retrieval_coverage") & (x["status"] == "fail")), noisy=F.coalesce(F.col("y_noise") >= 0.5, F.lit(False)),
        stale=F.array_distinct(F.concat("aged", "x_cited_invalid", "x_answer_bearing")), phantom=F.col("x_phantom"), post=F.col("y_probe") == "fail", security=F.exists("results", lambda r: (r["stage"] == "SECURITY") & (r["status"] == "fail")),
        mean=F.when(F.size("scores") > 0, F.col("mean")).otherwise(1.0), n=F.size("chunks"),
    )
    out = out.withColumns({f"r_{k}": c for k, c in of_run.items()})
    of_run = {k: F.col(f"r_{k}") for k in of_run}
    each = F.transform(whole, lambda x, i: F.struct(
        i.alias("claim"), x["text"].alias("text"), x["v"]["label"].alias("label"), x["v"]["reason"].alias("reason"), x["citation"].alias("citation"), x["probe"].alias("probe"),
        F.when(x["v"]["label"] != "entailed", attribution.causes_of(x["v"], **of_run)).alias("causes"),
    ))
    out = out.withColumns({"claim_causes": each, "findings": attribution.pinpoint(F.filter("all_nodes", lambda x: x["node"] == F.col("blamed")), F.col("run_id"))})
    out = out.withColumn("causes", F.get(F.filter("claim_causes", lambda c: c["causes"].isNotNull()), 0)["causes"])
    risk = F.get(F.reverse(F.array_sort(F.transform("results", lambda r: F.struct(X.place(r["security_risk"], X.RISKS).alias("o"), r["security_risk"].alias("r"))))), 0)["r"]
    known = F.filter(F.transform("results", lambda r: F.when(r["analyzer"] != "uncertainty", r["score"])), lambda s: s.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, s: a + s), F.size(known))
    others = F.array_distinct(F.filter(F.transform("results", lambda r: r["failure_type"]), lambda f: f.isNotNull() & (f != F.col("failure"))))
    chain = F.transform(F.array_sort(F.transform(F.filter("results", lambda r: r["status"] == "fail"), lambda r: F.struct(X.place(r["stage"], X.STAGES).alias("o"), r["at"].alias("at"), F.concat_ws(":", r["stage"], r["failure_type"]).alias("s")))), lambda x: x["s"])
    remedy = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REMEDY.items() for x in kv)), F.col("failure")), F.lit("look at the results"))
    ok = F.size(F.filter("nodes", lambda x: x["status"].isin("pass", "skip")))
    out = out.select(
        "run_id", "created_at", F.col("failure").alias("primary_failure"), F.col("failing_stage").alias("stage"), risk.alias("security_risk"), F.round(mean, 6).alias("confidence"),
        "results", F.col("blamed").alias("first_failing_node"), F.col("downstream").alias("downstream_nodes"), "missing_analyzers", "claim_causes", "run_marks", F.round(ok / F.greatest(F.size("nodes"), F.lit(1)), 2).alias("pipeline_health"), others.alias("also_considered"), F.array_join(chain, " > ").alias("failure_chain"), remedy.alias("remedy"),
        F.col("p_state")["applied"].alias("rules_applied"), attribution.selected(F.col("causes")).alias("cause"), attribution.chain(F.col("findings")).cast(CHAIN).alias("causal_chain"), attribution.trust(F.col("findings"), F.lit(True)).alias("trust"),
        requirements.evidence_lists(F.col("claims"), F.col("verdicts"), F.transform("chunks", lambda c: c["chunk_id"])).alias("claim_evidence"), requirements.covered(requirements.asked("query"), F.col("chunk_terms")).alias("requirements"),
    )
    review = F.col("primary_failure").isin(*X.UNANSWERABLE, "CONTRADICTED_CLAIM", "UNSUPPORTED_CLAIM", "LOW_CONFIDENCE") | (F.col("security_risk") == "HIGH")
    return out.withColumns({"should_have_answered": ~F.col("primary_failure").isin(*X.UNANSWERABLE), "human_review": review})
