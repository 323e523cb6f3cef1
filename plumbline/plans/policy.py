"""Which failure explains a run: tiers, a six-key order, suppression, named rules in sequence, and the gate for grounded answers.

Everything is data: a condition names failure types, analyzers, statuses and marks, and tables of conditions give tiers,
specificity and rules. A run's candidates are one array, so the whole policy is an expression over a row: no shuffle, no
Python. Marks say what a candidate's evidence holds, e.g. ``reason:phantom_citation`` or ``explicit_contradiction``; those that
follow from others are derived here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as X

TEXTS = "array<string>"
CANDIDATE = f"struct<analyzer:string,at:int,weight:double,status:string,failure_type:string,stage:string,calibration:string,evidence:{TEXTS},marks:{TEXTS}>"
COND = f"struct<types:{TEXTS},analyzers:{TEXTS},statuses:{TEXTS},every:{TEXTS},some:{TEXTS},none:{TEXTS}>"
STATE = f"struct<w:{CANDIDATE},fired:array<int>,applied:{TEXTS}>"


@dataclass(frozen=True)
class If:
    """A condition on a candidate; what is empty does not restrict."""

    types: tuple[str, ...] = ()
    analyzers: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    none: tuple[str, ...] = ()

    def data(self) -> dict:
        return {n: list(getattr(self, n)) for n in ("types", "analyzers", "statuses", "every", "some", "none")}


def table(rows: list[dict], of: str) -> Column:
    """Fixed rows as an array of structs: one literal, which the planner folds."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{of}>>")


def holds(c: Column, k: Column) -> Column:
    """Whether a candidate meets a condition; both are structs."""
    free = lambda a, test: (F.size(a) == 0) | test
    return (
        free(k["types"], F.array_contains(k["types"], c["failure_type"]))
        & free(k["analyzers"], F.array_contains(k["analyzers"], c["analyzer"]))
        & free(k["statuses"], F.array_contains(k["statuses"], c["status"]))
        & (F.size(F.array_except(k["every"], c["marks"])) == 0)
        & free(k["some"], F.arrays_overlap(k["some"], c["marks"]))
        & ~F.arrays_overlap(k["none"], c["marks"])
    )


@dataclass(frozen=True)
class Rule:
    """If the winner meets ``win``, the first candidate of the pool that meets ``then`` takes its place (by ``order`` of types, if given).

    ``needs`` are marks that some result of the run must hold; a candidate that meets ``unless`` stops the rule. ``rewrite`` and
    ``stage`` change the new winner; with ``keep`` the old one stays and is only rewritten. Of rules of one group the first that applies is the last.
    """

    name: str
    group: int
    win: If
    then: If = field(default_factory=If)
    needs: tuple[str, ...] = ()
    unless: If | None = None
    order: tuple[str, ...] = ()
    rewrite: str = ""
    stage: str = ""
    keep: bool = False

    def data(self) -> dict:
        plain = {n: getattr(self, n) for n in ("name", "group", "rewrite", "stage", "keep")}
        return plain | {"win": self.win.data(), "then": self.then.data(), "needs": list(self.needs), "unless": (self.unless or If(types=("-",))).data(), "order": list(self.order)}


RULE = f"name:string,group:int,win:{COND},then:{COND},needs:{TEXTS},unless:{COND},order:{TEXTS},rewrite:string,stage:string,keep:boolean"

UNSUPPORTED, CONTRADICTED, MISMATCH, POST = "UNSUPPORTED_CLAIM", "CONTRADICTED_CLAIM", "CITATION_MISMATCH", "POST_RATIONALIZED_CITATION"
INSUFFICIENT, STALE, SCOPE, ANOMALY, UNSURE, DEPTH = "INSUFFICIENT_CONTEXT", "STALE_RETRIEVAL", "SCOPE_VIOLATION", "RETRIEVAL_ANOMALY", "LOW_CONFIDENCE", "RETRIEVAL_DEPTH_LIMIT"
PARSER = ("TABLE_STRUCTURE_LOSS", "HIERARCHY_FLATTENING", "METADATA_LOSS", "PARSER_STRUCTURE_LOSS", "CHUNKING_BOUNDARY_ERROR")
FAIL, WARN = ("fail",), ("warn",)
PHANTOM, MISSING, RELATED = "reason:phantom_citation", "reason:citation_missing", "reason:related_non_supporting_citation"
REASONS = (PHANTOM, "reason:post_rationalized_citation", RELATED, MISSING, "reason:cited_source_contradicts_claim")
GRAVE = ("severity:cited_invalid_source", "severity:answer_bearing_invalid_source")
LIGHT = "severity:retrieved_only_stale_source"
SUFFICIENCY = tuple(f"sufficiency:{x}" for x in ("missing_critical_requirement", "partial_requirement_coverage", "missing_exception", "missing_scope_condition", "missing_temporal_or_freshness_requirement", "stale_context_mistaken_as_sufficient"))

#: Marks that follow from others: (mark, conditions of which one suffices), in order.
DERIVED = (
    ("explicit_root", (If(types=(POST,), analyzers=("citation_probe",)), If(some=REASONS))),
    ("explicit_sufficiency", (If(some=SUFFICIENCY),)),
    ("concrete", (If(types=(MISMATCH,), some=REASONS[:3] + REASONS[4:]), If(types=(INSUFFICIENT,), some=SUFFICIENCY), If(types=(SCOPE,), some=("quoted_entity",)))),
    ("explicit_scope", (If(types=(SCOPE,), some=("quoted_entity",)), If(types=(SCOPE,), analyzers=("depth",)))),
    ("stale_root", (If(types=(STALE,), some=GRAVE), If(types=(STALE,), analyzers=("staleness",)))),
    ("root_target", (
        If(types=(INSUFFICIENT,), analyzers=("sufficiency", "claim_sufficiency", "retrieval")), If(types=(UNSUPPORTED,), analyzers=("grounding",), every=("candidate_backed",)), If(types=(STALE,), some=GRAVE),
        If(types=(SCOPE,), every=("explicit_scope",)), If(types=(ANOMALY,), every=("explicit_anomaly",)), If(types=(DEPTH,)),
    )),
)

#: Tier by the first condition that holds: 0 blocks, 1 is structured, 2 heuristic, 4 external advice; 3 for any other.
TIERS = (
    (0, If(types=("PROMPT_INJECTION", "PRIVACY_VIOLATION", "INCOMPLETE_DIAGNOSIS", *PARSER))),
    (0, If(types=("SUSPICIOUS_CHUNK",), analyzers=("injection", "poisoning", "anomaly"))),
    (4, If(some=("external_advisory",))),
    (1, If(analyzers=("depth",))),
    (1, If(types=(CONTRADICTED, UNSUPPORTED, MISMATCH, POST))),
    (1, If(types=(INSUFFICIENT, STALE), some=(*SUFFICIENCY, *GRAVE, LIGHT, "structured"))),
    (1, If(types=(STALE,), analyzers=("staleness",))),
    (1, If(analyzers=("verifier", "retrieval"), some=("structured",))),
    (1, If(types=(SCOPE,), some=("quoted_entity",))),
    (1, If(types=(UNSURE,), analyzers=("uncertainty",), some=("text_uncertainty", "ambiguity"))),
    (2, If(types=(ANOMALY, SCOPE, UNSURE, INSUFFICIENT))),
)

#: Specificity by the first condition that holds; 10 for any other.
SPECIFICITY = (
    (100, If(types=PARSER)),
    (95, If(types=("PROMPT_INJECTION", "PRIVACY_VIOLATION", CONTRADICTED))),
    (94, If(types=(MISMATCH,), analyzers=("citation_faithfulness",), every=(PHANTOM,))),
    (93, If(types=(MISMATCH,), analyzers=("citation_faithfulness",), every=("explicit_root",))),
    (92, If(types=(POST,), every=("explicit_root",))),
    (82, If(types=(POST,))),
    (92, If(types=(INSUFFICIENT,), analyzers=("sufficiency",), every=("explicit_sufficiency",))),
    (93, If(types=(UNSURE,), analyzers=("uncertainty",), some=("ambiguity",))),
    (93, If(types=(DEPTH,), analyzers=("depth",))),
    (91, If(types=(SCOPE,), analyzers=("depth",))),
    (89, If(types=(ANOMALY,), analyzers=("depth",))),
    (91, If(types=(SCOPE,), some=("quoted_entity",))),
    (90, If(types=("INCOMPLETE_DIAGNOSIS",))),
    (90, If(types=(INSUFFICIENT,), analyzers=("retrieval",))),
    (91, If(types=(STALE,), analyzers=("sufficiency",), some=("sufficiency:stale_context_mistaken_as_sufficient",))),
    (89, If(types=(STALE,), analyzers=("validity", "retrieval"), some=GRAVE)),
    (88, If(types=(INSUFFICIENT,), analyzers=("sufficiency", "claim_sufficiency"))),
    (81, If(types=(STALE,), analyzers=("validity", "retrieval"), some=(LIGHT,))),
    (80, If(types=(UNSUPPORTED, MISMATCH))),
    (75, If(types=(STALE,))),
    (70, If(types=(INSUFFICIENT,))),
    (30, If(types=(ANOMALY,))),
    (20, If(types=(SCOPE, UNSURE))),
)

#: How far a status of calibration counts.
CALIBRATION = {"deterministic": 5, "calibrated": 4, "provisional": 3, "preliminary_calibrated_v1": 2, "not_calibrated": 1, "uncalibrated": 1, "uncalibrated_locally": 0}
INELIGIBLE = ("inconsistency",)
META = ("taxonomy", "attribution")
GROUNDED_MAY_CLEAR = (STALE, "INCONSISTENT_CHUNKS", SCOPE, ANOMALY, MISMATCH, INSUFFICIENT)

RULES = (
    Rule("a phantom citation comes before what it leads to", 1, If((POST, CONTRADICTED)), If((MISMATCH,), every=(PHANTOM,)), stage="GROUNDING"),
    Rule("citations attached afterwards come before an incidental phantom", 2, If((MISMATCH,), every=(PHANTOM,)), If((POST,), ("citation_probe",), every=("explicit_root", "mixed_attachment"))),
    Rule("faithfulness judges citations", 3, If((MISMATCH,), ("citations",)), If((MISMATCH, POST), ("citation_faithfulness",))),
    Rule("then the probe does", 3, If((MISMATCH,), ("citations",), none=(PHANTOM,)), If((POST,), ("citation_probe",))),
    Rule("a citation without a root of its own is a symptom", 4, If((MISMATCH, POST), none=("explicit_root",)), If(statuses=FAIL, every=("root_target",)), order=(STALE, UNSUPPORTED, SCOPE, ANOMALY, DEPTH, INSUFFICIENT)),
    Rule("so is a missing or a related one", 4, If((MISMATCH, POST), some=(MISSING, RELATED)), If(statuses=FAIL, every=("root_target",)), order=(STALE, UNSUPPORTED, SCOPE, ANOMALY, DEPTH, INSUFFICIENT)),
    Rule("grounding comes before a probe of related sources", 5, If((POST,), ("citation_probe",)), If((UNSUPPORTED,), ("grounding",), FAIL), needs=("related_non_supporting",), unless=If((STALE,), some=GRAVE)),
    Rule("an answer that says it is unsure comes before generic symptoms", 6, If((MISMATCH, INSUFFICIENT, SCOPE), none=("concrete",)), If((UNSURE,), ("uncertainty",), some=("text_uncertainty", "ambiguity"))),
    Rule("a retrieval anomaly that warns comes before a missing citation", 7, If((MISMATCH,), every=(MISSING,)), If((ANOMALY,), statuses=WARN, every=("explicit_anomaly",))),
    Rule("a judged claim comes before generic insufficiency", 8, If((INSUFFICIENT,), none=("explicit_sufficiency", "missing_context")), If((UNSUPPORTED, CONTRADICTED), ("grounding",), every=("candidate_backed",))),
    Rule("an explicit breach of scope comes before generic insufficiency", 9, If((INSUFFICIENT,), none=("explicit_sufficiency",)), If((SCOPE,), statuses=FAIL, every=("explicit_scope",))),
    Rule("partial support makes it an unsupported claim", 10, If((INSUFFICIENT,), ("sufficiency", "retrieval")), If((UNSUPPORTED,), ("grounding",), every=("partial_support",))),
    Rule("an unsupported claim needs candidates", 11, If((UNSUPPORTED,), ("grounding",), none=("candidate_backed",)), If((INSUFFICIENT,), statuses=FAIL)),
    Rule("a contradiction taken from inexplicit grounding is no more than unsupported", 12, If((CONTRADICTED,), ("citation_faithfulness", "citation_probe", "verifier"), none=("explicit_contradiction",)), needs=("inexplicit_grounding",), rewrite=UNSUPPORTED, keep=True),
    Rule("grounding's explicit contradiction is the better one", 12, If((CONTRADICTED,), none=("explicit_contradiction",)), If((CONTRADICTED,), ("grounding",), every=("explicit_contradiction",))),
    Rule("grounding's other contradiction is no more than unsupported", 12, If((CONTRADICTED,), none=("explicit_contradiction",)), If((CONTRADICTED,), ("grounding",), every=("candidate_backed",)), rewrite=UNSUPPORTED),
    Rule("the winner's own contradiction is no more than unsupported", 12, If((CONTRADICTED,), ("grounding",), every=("candidate_backed",), none=("explicit_contradiction",)), rewrite=UNSUPPORTED, keep=True),
    Rule("a contradiction without any ground gives way", 12, If((CONTRADICTED,), none=("explicit_contradiction",)), If((UNSUPPORTED, INSUFFICIENT))),
    Rule("a citation attached afterwards needs a root", 13, If((POST,), none=("explicit_root",)), If((UNSUPPORTED, INSUFFICIENT), ("grounding", "sufficiency", "retrieval"))),
    Rule("a stale source is the root of what it leads to", 14, If((CONTRADICTED, POST, UNSUPPORTED)), If((STALE,), every=("stale_root",))),
    Rule("an explicit anomaly comes before a weak breach of scope", 15, If((SCOPE,), none=("explicit_scope",)), If((ANOMALY,), every=("explicit_anomaly",))),
    Rule("strong signals come before weak ones", 16, If(every=("weak",)), If(every=("strong",))),
    Rule("coverage of terms gives way to a judged claim", 16, If((INSUFFICIENT,), every=("signal:term_coverage_fallback",)), If((UNSUPPORTED,), every=("signal:candidate_backed_unsupported_claim",))),
    Rule("a missing citation gives way to structured failures", 16, If((MISMATCH,), every=(MISSING,)), If((UNSUPPORTED, CONTRADICTED, STALE, MISMATCH), some=("strong", "tier:0", "tier:1"))),
    Rule("advice gives way to an explicit contradiction", 16, If(some=("weak", "tier:2", "tier:4")), If((CONTRADICTED,), every=("signal:grounding_contradiction", "explicit_contradiction"))),
    Rule("so does uncertainty", 16, If(analyzers=("uncertainty",)), If((CONTRADICTED,), every=("signal:grounding_contradiction", "explicit_contradiction"))),
    Rule("external advice alone decides nothing", 16, If(some=("external_advisory",)), If(none=("external_advisory",))),
    Rule("an invalid source comes before its symptoms", 16, If((UNSUPPORTED, MISMATCH, POST)), If((STALE,), ("validity",), every=("strong",))),
    Rule("a strong contradiction comes before generic symptoms", 16, If((INSUFFICIENT, ANOMALY, SCOPE)), If((CONTRADICTED,), every=("explicit_contradiction", "signal:grounding_contradiction", "strong"))),
)


def by_first(c: Column, rows: Column, default: int) -> Column:
    """The value of the first condition that holds, of a table made by ``ladder``."""
    return F.coalesce(F.get(F.filter(rows, lambda r: holds(c, r["if"])), 0)["value"], F.lit(default))


def ladder(rows) -> Column:
    return table([{"value": v, "if": k.data()} for v, k in rows], f"value:int,if:{COND}")


def marked(c: Column) -> Column:
    """A candidate with its derived marks, each by conditions that may read the ones before. The table is folded as data, so the expression grows with its length."""
    rows = table([{"name": name, "any": [k.data() for k in conditions]} for name, conditions in DERIVED], f"name:string,any:array<{COND}>")

    def add(acc: Column, d: Column) -> Column:
        more = acc.withField("marks", F.concat(acc["marks"], F.array(d["name"]))).cast(CANDIDATE)
        return F.when(F.exists(d["any"], lambda k: holds(acc, k)), more).otherwise(acc)

    return F.aggregate(rows, c.cast(CANDIDATE), add)


def ranked(candidates: Column) -> Column:
    """Candidates in order of tier, specificity, weight, calibration, priority and place: structs of these keys and the candidate."""
    calibration = F.create_map(*(F.lit(x) for kv in CALIBRATION.items() for x in kv))

    def keyed(x: Column) -> Column:
        c = x["c"]
        return F.struct(
            x["tier"].alias("tier"), (-by_first(c, ladder(SPECIFICITY), 10)).alias("specificity"), (-c["weight"]).alias("weight"), (-F.coalesce(F.element_at(calibration, c["calibration"]), F.lit(0))).alias("calibration"),
            X.place(c["failure_type"], X.PRIORITY).alias("priority"), c["at"].alias("at"), c.withField("marks", F.concat(c["marks"], F.array(F.concat(F.lit("tier:"), x["tier"].cast("string"))))).alias("c"),
        )

    return F.array_sort(F.transform(F.transform(candidates, lambda c: F.struct(by_first(c, ladder(TIERS), 3).alias("tier"), c.alias("c"))), keyed))


def eligible(pool: Column) -> Column:
    """The candidates of a ranked pool that may win.

    Those of analyzers that never win go, external advice goes, meta analyzers go where any other speaks, and weak or
    merely lexical signals go where firmer evidence stands - unless nothing would be left.
    """
    has = lambda c, m: F.array_contains(c["c"]["marks"], m)
    signalled = lambda c: F.exists(c["c"]["marks"], lambda m: m.isin("weak", "strong", "medium"))
    firm = F.exists(pool, lambda c: F.when(signalled(c), has(c, "strong")).otherwise(c["tier"] <= 1))
    others = F.exists(pool, lambda c: ~c["c"]["analyzer"].isin(*META))
    may = F.filter(pool, lambda c: ~c["c"]["analyzer"].isin(*INELIGIBLE) & (c["tier"] != 4) & ~has(c, "external_advisory") & ~(others & c["c"]["analyzer"].isin(*META)))
    firmer = F.filter(may, lambda c: ~(firm & (has(c, "weak") | has(c, "lexical"))))
    return F.when(F.size(firmer) > 0, firmer).otherwise(may)


def winner(pool: Column, run_marks: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(w, applied): the first of the failing candidates after the rules, in sequence, and the names of those that applied. ``pool`` is ranked and eligible."""
    failing = F.transform(F.filter(pool, lambda x: x["c"]["status"] == "fail"), lambda x: x["c"])
    start = F.struct(F.get(failing, 0).alias("w"), F.array().cast("array<int>").alias("fired"), F.array().cast(TEXTS).alias("applied")).cast(STATE)

    def apply(state: Column, rule: Column) -> Column:
        w = state["w"]
        found = F.filter(failing, lambda c: holds(c, rule["then"]) & (c["at"] != w["at"]))
        by_order = F.get(F.array_sort(F.transform(found, lambda c, i: F.struct(F.array_position(rule["order"], c["failure_type"]).alias("o"), i.alias("i"), c.alias("c")))), 0)["c"]
        target = F.when(rule["keep"], w).when(F.size(rule["order"]) > 0, by_order).otherwise(F.get(found, 0))
        fires = (
            holds(w, rule["win"]) & ~F.array_contains(state["fired"], rule["group"]) & ((F.size(rule["needs"]) == 0) | F.arrays_overlap(rule["needs"], run_marks))
            & ~F.exists(failing, lambda c: holds(c, rule["unless"])) & target.isNotNull()
        )
        changed = target.withField("failure_type", F.when(rule["rewrite"] != "", rule["rewrite"]).otherwise(target["failure_type"])).withField("stage", F.when(rule["stage"] != "", rule["stage"]).otherwise(target["stage"]))
        new = F.struct(changed.alias("w"), F.concat(state["fired"], F.array(rule["group"])).alias("fired"), F.concat(state["applied"], F.array(rule["name"])).alias("applied")).cast(STATE)
        return F.when(F.coalesce(fires, F.lit(False)), new).otherwise(state)

    return F.aggregate(table([r.data() for r in rules], RULE), start, apply)


def decided(candidates: Column, run_marks: Column, rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Steps of the decision, each a column that the next one reads: ``p_marked``, ``p_pool``, ``p_eligible``, ``p_state`` and ``p_primary``, null where nothing fails or a grounded answer clears it."""
    top, state = F.col("p_state")["w"], F.col("p_state")
    blocked = F.exists("p_eligible", lambda x: x["tier"] == 0)
    cleared = top["failure_type"].isin(*GROUNDED_MAY_CLEAR) & ~blocked & F.array_contains(run_marks, "entailment_clean")
    return {
        "p_marked": F.transform(candidates.cast(f"array<{CANDIDATE}>"), marked),
        "p_pool": ranked(F.col("p_marked")),
        "p_eligible": eligible(F.col("p_pool")),
        "p_state": winner(F.col("p_eligible"), run_marks, rules),
        "p_primary": F.when(F.coalesce(~cleared, F.lit(True)), state["w"]),
    }


def decide(runs, candidates: Column, run_marks: Column, rules: tuple[Rule, ...] = RULES):
    """``runs`` with the steps of ``decided`` added one after another."""
    for name, c in decided(candidates, run_marks, rules).items():
        runs = runs.withColumn(name, c)
    return runs


def alternatives(pool: Column, primary: Column) -> Column:
    """The other candidates that might explain the run: those of the winner's status first, then in order."""
    rest = F.filter(pool, lambda x: ~x["c"]["at"].eqNullSafe(primary["at"]))
    named = F.transform(rest, lambda x, i: F.struct((x["c"]["status"] != F.coalesce(primary["status"], F.lit("fail"))).alias("o"), i.alias("i"), x["c"]["failure_type"].alias("f")))
    return F.array_distinct(F.transform(F.array_sort(named), lambda x: x["f"]))
