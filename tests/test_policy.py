from plumbline.plans import policy as P
from plumbline.functions import taxonomy as X

from pyspark.sql import functions as F

U, C, M, PO, I, S, SC, A, L = P.UNSUPPORTED, P.CONTRADICTED, P.MISMATCH, P.POST, P.INSUFFICIENT, P.STALE, P.SCOPE, P.ANOMALY, P.UNSURE


def c(failure, analyzer, *marks, status="fail", weight=1.0, stage="GROUNDING", calibration="uncalibrated"):
    return dict(analyzer=analyzer, weight=weight, status=status, failure_type=failure, stage=stage, calibration=calibration, evidence=[], marks=list(marks))


# (candidates, marks of the run, primary failure, analyzer)
CASES = [
    ([c(C, "grounding", "explicit_contradiction"), c(M, "citation_faithfulness", P.PHANTOM)], [], M, "citation_faithfulness"),
    ([c(M, "citation_faithfulness", P.PHANTOM), c(PO, "citation_probe", "mixed_attachment")], [], PO, "citation_probe"),
    ([c(M, "citation_faithfulness", P.PHANTOM), c(PO, "citation_probe")], [], M, "citation_faithfulness"),
    ([c(M, "citation_faithfulness", P.MISSING), c(I, "sufficiency", "sufficiency:missing_exception")], [], I, "sufficiency"),
    ([c(M, "citation_faithfulness", P.MISSING), c(U, "grounding", "candidate_backed"), c(S, "validity", P.GRAVE[0])], [], S, "validity"),
    ([c(PO, "citation_probe"), c(U, "grounding", "candidate_backed")], ["related_non_supporting"], U, "grounding"),
    ([c(I, "retrieval", "structured"), c(L, "uncertainty", "text_uncertainty")], [], L, "uncertainty"),
    ([c(I, "sufficiency", "sufficiency:missing_exception"), c(L, "uncertainty", "text_uncertainty")], [], I, "sufficiency"),
    ([c(I, "sufficiency"), c(U, "grounding", "candidate_backed")], [], U, "grounding"),
    ([c(I, "sufficiency", "sufficiency:missing_exception"), c(U, "grounding", "candidate_backed")], [], I, "sufficiency"),
    ([c(I, "retrieval", "structured"), c(SC, "scope", "quoted_entity")], [], SC, "scope"),
    ([c(I, "sufficiency", "sufficiency:missing_exception"), c(U, "grounding", "candidate_backed", "partial_support")], [], U, "grounding"),
    ([c(U, "grounding"), c(I, "sufficiency")], [], I, "sufficiency"),
    ([c(C, "citation_probe")], ["inexplicit_grounding"], U, "citation_probe"),
    ([c(C, "verifier", weight=2.0), c(C, "grounding", "explicit_contradiction")], [], C, "grounding"),
    ([c(C, "verifier", weight=2.0), c(C, "grounding", "candidate_backed")], [], U, "grounding"),
    ([c(C, "grounding", "candidate_backed")], [], U, "grounding"),
    ([c(C, "verifier"), c(I, "sufficiency")], [], I, "sufficiency"),
    ([c(C, "grounding", "explicit_contradiction", "candidate_backed")], [], C, "grounding"),
    ([c(C, "grounding", "explicit_contradiction"), c(S, "staleness")], [], S, "staleness"),
    ([c(SC, "scope"), c(A, "anomaly", "explicit_anomaly")], [], A, "anomaly"),
    ([c(SC, "scope", "quoted_entity"), c(A, "anomaly", "explicit_anomaly")], [], SC, "scope"),
    ([c("PROMPT_INJECTION", "injection"), c(C, "grounding", "explicit_contradiction")], [], "PROMPT_INJECTION", "injection"),
    ([c("INCONSISTENT_CHUNKS", "inconsistency")], [], None, None),
    ([c(A, "anomaly", status="warn")], [], None, None),
    ([c(SC, "scope", "lexical"), c(U, "grounding", "candidate_backed")], [], U, "grounding"),
    ([c(SC, "scope", "lexical")], [], SC, "scope"),
    ([c(U, "advice", "external_advisory")], [], None, None),
    ([c(L, "taxonomy"), c(A, "anomaly")], [], A, "anomaly"),
    ([c(S, "staleness")], ["entailment_clean"], None, None),
    ([c(S, "staleness"), c("PROMPT_INJECTION", "injection")], ["entailment_clean"], "PROMPT_INJECTION", "injection"),
    ([c(U, "grounding", "candidate_backed", "weak"), c(A, "anomaly", "strong")], [], A, "anomaly"),
    ([], [], None, None),
]


def decide(spark, cases, rules=P.RULES):
    rows = [(i, [x | {"at": k} for k, x in enumerate(own)], marks) for i, (own, marks, *_) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, c array<{P.CANDIDATE}>, m array<string>")
    return P.decide(df, F.col("c"), F.col("m"), rules).select("i", "p_primary", "p_pool", "p_state").orderBy("i").collect()


def test_rules(spark):
    for case, r in zip(CASES, decide(spark, CASES)):
        got = (r.p_primary.failure_type, r.p_primary.analyzer) if r.p_primary else (None, None)
        assert got == tuple(case[2:]), (case, r.p_state.applied)


def made(cond, analyzer, at):
    """A candidate that meets a condition."""
    own = c((cond.types or ("OTHER",))[0], (cond.analyzers or (analyzer,))[0], *cond.every, *cond.some[:1], status=(cond.statuses or ("fail",))[0])
    return own | {"at": at, "evidence": []}


def test_each_rule_alone(spark):
    """Each rule turns a winner that meets its condition to a candidate that meets the other one, and leaves any other winner."""
    rows = []
    for i, rule in enumerate(P.RULES):
        hit, other = made(rule.win, "first", 0), made(rule.then, "second", 1)
        miss = hit | {"failure_type": "OTHER", "analyzer": "nobody", "marks": list(rule.win.none)[:1]}
        for k, w in enumerate((hit, miss)):
            rows.append((2 * i + k, [{"c": w}, {"c": other}], list(rule.needs)))
    df = spark.createDataFrame(rows, f"i int, pool array<struct<c:{P.CANDIDATE}>>, m array<string>")
    states = [r.s for r in df.select("i", P.winner(F.col("pool"), F.col("m")).alias("s")).orderBy("i").collect()]
    alone = {}
    for i, rule in enumerate(P.RULES):
        one = df.where(F.col("i").between(2 * i, 2 * i + 1)).select("i", P.winner(F.col("pool"), F.col("m"), (rule,)).alias("s"))
        alone[rule.name] = one
    union = None
    for name, one in alone.items():
        union = one if union is None else union.unionByName(one)
    got = {r.i: r.s for r in union.collect()}
    assert len(states) == 2 * len(P.RULES)
    for i, rule in enumerate(P.RULES):
        if "warn" in rule.then.statuses:  # the pool holds failures only, so a warning never takes a citation's place
            assert got[2 * i].applied == []
            continue
        assert got[2 * i].applied == [rule.name] and got[2 * i].w.at == (0 if rule.keep else 1), rule
        assert got[2 * i].w.failure_type == (rule.rewrite or (rule.then.types or ("OTHER",))[0])
        if rule.win.types or rule.win.analyzers or rule.win.none:
            assert got[2 * i + 1].applied == [], rule


def brute_key(x, k):
    def first(table, default, marks):
        for value, cond in table:
            if holds(cond, marks):
                return value
        return default

    def holds(cond, marks):
        return ((not cond.types or x["failure_type"] in cond.types) and (not cond.analyzers or x["analyzer"] in cond.analyzers) and (not cond.statuses or x["status"] in cond.statuses)
                and set(cond.every) <= marks and (not cond.some or bool(set(cond.some) & marks)) and not set(cond.none) & marks)

    marks = set(x["marks"])
    for name, conditions in P.DERIVED:
        if any(holds(cond, marks) for cond in conditions):
            marks.add(name)
    priority = X.PRIORITY.index(x["failure_type"]) if x["failure_type"] in X.PRIORITY else len(X.PRIORITY)
    return (first(P.TIERS, 3, marks), -first(P.SPECIFICITY, 10, marks), -x["weight"], -P.CALIBRATION.get(x["calibration"], 0), priority, k)


def test_order_against_brute_force(spark):
    import random

    rng = random.Random(4)
    names, who = [U, C, M, PO, I, S, SC, A, L, "PROMPT_INJECTION", "SUSPICIOUS_CHUNK", "OTHER"], ["grounding", "citation_faithfulness", "citation_probe", "sufficiency", "validity", "scope", "anomaly", "uncertainty", "depth", "retrieval"]
    marks = [P.PHANTOM, P.MISSING, P.GRAVE[0], P.LIGHT, "quoted_entity", "text_uncertainty", "structured", *P.SUFFICIENCY[:2]]
    pools = [([c(rng.choice(names), rng.choice(who), *rng.sample(marks, rng.randint(0, 3)), weight=rng.choice([0.5, 0.9, 1.0]), calibration=rng.choice(list(P.CALIBRATION))) for _ in range(rng.randint(1, 8))], []) for _ in range(60)]
    for (own, _), r in zip(pools, decide(spark, pools, rules=())):
        order = sorted(range(len(own)), key=lambda k: brute_key(own[k], k))
        assert [x.c.at for x in r.p_pool] == order
