import itertools
import random

from pyspark.sql import functions as F

from plumbline.functions import text as W
from plumbline.operators import requirements as R

RUN = "run long"
REQ = f"{RUN}, req int, importance string, terms array<string>"
CHUNK = f"{RUN}, rank long, chunk string, terms array<string>"


def tables(spark, runs):
    reqs = [(i, j + 1, "critical", t) for i, (rs, _) in enumerate(runs) for j, t in enumerate(rs)]
    chunks = [(i, k, f"c{k}", t) for i, (_, cs) in enumerate(runs) for k, t in enumerate(cs)]
    return spark.createDataFrame(reqs, REQ), spark.createDataFrame(chunks, CHUNK)


def brute(runs):
    out = {}
    for i, (reqs, chunks) in enumerate(runs):
        for j, t in enumerate(reqs):
            hits = [set(t) & set(c) for c in chunks]
            best = max((len(h) for h in hits), default=0) / len(t) if t else 0.0
            ties = [k for k, h in enumerate(hits) if best and len(h) == best * len(t)]
            held = set().union(*(hits[k] for k in ties)) if ties else set()
            out[i, j + 1] = (best, "covered" if best > 0.5 else "partial" if best >= 0.25 else "missing", [f"c{k}" for k in ties] if best >= 0.25 else [], sorted(held), sorted(set(t) - held))
    return out


def random_runs(seed, n=40):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    some = lambda: rng.sample(words, rng.randint(1, 5))
    return [([some() for _ in range(rng.randint(1, 4))], [some() for _ in range(rng.randint(0, 6))]) for _ in range(n)] + [([[]], [["alpha"]]), ([["alpha"]], [[]])]


def test_coverage_keeps_ties_and_misses(spark):
    runs = random_runs(1)
    reqs, chunks = tables(spark, runs)
    got = {(r.run, r.req): (r.ratio, r.status, r.chunks, r.matched, r.missed) for r in R.coverage(reqs, chunks, "run").collect()}
    assert got == brute(runs)


def test_nested_rows_agree_with_tables(spark):
    runs = random_runs(2)
    df = spark.createDataFrame([(i, [(j + 1, t) for j, t in enumerate(rs)], cs) for i, (rs, cs) in enumerate(runs)], "run int, reqs array<struct<req:int,terms:array<string>>>, chunk_terms array<array<string>>")
    rows = df.select("run", F.explode(R.covered(F.col("reqs"), F.col("chunk_terms"))).alias("r")).select("run", "r.*").collect()
    assert {(r.run, r.req): (r.ratio, r.status, [f"c{k}" for k in r.places], r.matched, r.missed) for r in rows} == brute(runs)


def greedy(holds, can):
    left, chosen = set(can), []
    while left and holds:
        chunk = max(sorted(holds), key=lambda c: len(holds[c] & left))
        if not holds[chunk] & left:
            break
        left -= holds[chunk]
        chosen.append(chunk)
    return chosen


def test_cover_is_greedy_and_whole(spark):
    runs = random_runs(3)
    reqs, chunks = tables(spark, runs)
    rows = R.support(R.coverage(reqs, chunks, "run"), "run").withColumn("chosen", R.least_cover(F.col("holds"), F.col("can"))).collect()
    want = brute(runs)
    assert len(rows) == len({r for r, _ in want})
    for r in rows:
        own = {q: v for (i, q), v in want.items() if i == r.run}
        can = [q for q, v in own.items() if v[1] == "covered"]
        holds = {}
        for q in can:
            for c in own[q][2]:
                holds.setdefault(c, set()).add(q)
        assert r.can == sorted(can) and r.uncovered == sorted(set(own) - set(can)) and r.n == len(own)
        assert (r.chosen or []) == greedy(holds, can)
        assert set(itertools.chain(*(holds[c] for c in r.chosen or []))) == set(can)


def test_questions_fall_apart(spark):
    cases = [
        ("What is the refund window? When does the plan expire?", ["What is the refund window", "When does the plan expire"]),
        ("List fees, terms and how to install it", ["List fees", "terms", "how to install it"]),
        ("salt and pepper", ["salt and pepper"]),
        ("Who is it? And the?", []),
        ("", []),
        (None, []),
    ]
    got = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "i int, q string").withColumn("p", R.parts("q")).orderBy("i").collect()
    assert [r.p for r in got] == [p for _, p in cases]
    kinds = ["how many seats", "why it fell", "how to apply", "the old versus the new", "all but exceptions", "which person", "see section four", "until june", "if eligible", "blue"]
    rows = spark.createDataFrame([(k,) for k in kinds], "p string").select(R.kind(F.col("p")).alias("k")).collect()
    short = ["value", "causal_support", "step_or_procedure", "comparison_baseline", "exception_or_limitation", "entity", "source_or_citation", "date_or_time", "condition_or_scope", "condition_or_scope"]
    assert [r.k for r in rows] == [f"required_{s}" for s in short]


def test_claims_without_evidence(spark):
    v = "array<struct<label:string,supporting:array<int>,candidates:array<int>,contradicting:array<int>>>"
    rows = [(["a", "b", "c"], [("entailed", [0], [0, 1], []), ("unsupported", [], [2], []), ("contradicted", [], [], [1])], ["x", "y", "z"]), ([], [], [])]
    got = spark.createDataFrame(rows, f"claims array<string>, verdicts {v}, ids array<string>").select(R.evidence_lists(F.col("claims"), F.col("verdicts"), F.col("ids")).alias("e")).collect()
    assert (got[0].e.sufficient, got[0].e.missing_evidence, got[0].e.affected_claims, got[0].e.evidence_chunks) == (False, ["b"], ["b", "c"], ["x", "y", "z"])
    assert (got[1].e.sufficient, got[1].e.evidence_chunks) == (True, [])


def test_drift_needs_words_of_scope_on_both_sides(spark):
    cases = [("federal parks budget report", "domestic parks museum list", "fail"), ("federal parks budget", "parks museum list", "pass"), ("parks budget", "domestic museum", "pass"), ("", "domestic", "pass")]
    df = spark.createDataFrame(cases, "q string, c string, want string")
    got = df.withColumn("d", R.drift(W.terms("q"), W.terms("c"))).collect()
    assert [r.d.status for r in got] == [r.want for r in got]
