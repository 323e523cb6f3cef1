import random

import pytest

from plumbline.operators import triplets as T
from plumbline.plans.evidence import CLAIMED

GRAMMAR = [
    ("The annual plan costs $40 per month and includes phone support.", [("annual plan", "cost", "$40", False, ["per month"], ["$40"]), ("annual plan", "have", "phone support", False, [], [])]),
    ("Refunds are not allowed after 30 days.", [("refund", "be allow", "after 30 days", True, [], ["30day"])]),
    ("The committee does not require a permit, but the city requires an inspection.", [("committee", "require", "a permit", True, [], []), ("city", "require", "an inspection", False, [], [])]),
    ("Order No. 5 sanctions $1,200.50 up to 3 years.", [("order no 5", "sanction", "$1,200.50", False, ["up to"], ["$1200.50", "3year"])]),
    ("The device that is old has a battery", [("device", "have", "a battery", False, [], [])]),
    ("Guests must have badges. Pets are prohibited!", [("guest", "require", "badges", False, [], []), ("pets", "be prohibit", "", False, [], [])]),
    ("Rain leads to floods; the dam was never replaced", [("rain", "cause", "floods", False, [], []), ("dam", "be replace", "", True, [], [])]),
    ("The office is located in Paris.", [("office", "locate", "Paris", False, [], [])]),
    ("is blue", []), ("and, and is", []), ("Nothing here", []), ("", []), (None, []),
]


@pytest.mark.parametrize("text,want", GRAMMAR)
def test_grammar(text, want):
    got = T.triplets(text)
    assert [(t["key"], t["predicate"], t["object"], t["negated"], t["qualifiers"], [v["value"] for v in t["values"]]) for t in got] == want
    for t in got:
        part = text[t["start"] : t["end"]]
        assert t["object"] in part and part == part.strip()


def test_long_text_and_places(spark):
    text = "The plan costs $5. " * 20_000
    rows = T.extracted(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, text string"), "i")
    assert rows.count() == 20_000
    last = rows.where("at = 19999").select("t.*").first()
    assert text[last.start : last.end] == "The plan costs $5"


def test_fixed_claims(spark):
    claims = spark.createDataFrame([(i, 0, c) for i, (c, _, _) in enumerate(CLAIMED)], "run int, claim int, text string")
    chunks = spark.createDataFrame([(i, k, t) for i, (_, ts, _) in enumerate(CLAIMED) for k, t in enumerate(ts)], "run int, chunk int, text string")
    got = {r.run: r for r in T.verified(claims, chunks, "run").collect()}
    assert [got[i].label for i in range(len(CLAIMED))] == [want for *_, want in CLAIMED]
    assert got[5].supporting == [0, 1] and got[7].contradicting == [0] and got[8].n_triplets == 0


def judged(claim, chunk):
    """The pair rule in plain Python."""
    mine, other = [(v["kind"], v["value"]) for v in claim["values"]], [(v["kind"], v["value"]) for v in chunk["values"]]
    whole, held = set(claim["words"]) <= set(chunk["words"]), set(mine) <= set(other)
    kinds = {k for k, _ in mine} & {k for k, _ in other}
    clash = any(k in {q for q, _ in other} and (k, v) not in other for k, v in mine)
    about = not claim["words"] or not chunk["words"] or set(claim["words"]) & set(chunk["words"])
    if claim["negated"] != chunk["negated"]:
        return "contradicted" if whole and (held or not kinds) else None
    if about and clash and not claim["negated"]:
        return "contradicted"
    return "entailed" if whole and held else None


def test_verification_equals_all_pairs(spark):
    rng = random.Random(3)
    subjects, verbs, objects = ["The plan", "A plan", "The fee", "Staff"], ["costs", "does not include", "includes", "is", "is not", "requires"], ["$5", "$6", "phone support", "5 phones", "phone support for 3 days", "nothing"]
    text = lambda: " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)}{rng.choice(['.', ' and includes maps.'])}" for _ in range(rng.randint(0, 3)))
    claims = [(r, c, text()) for r in range(30) for c in range(3)]
    chunks = [(r, k, text()) for r in range(30) for k in range(rng.randint(0, 3))]
    got = {(r.run, r.claim): (r.label, r.supporting or [], r.contradicting or []) for r in T.verified(spark.createDataFrame(claims, "run int, claim int, text string"), spark.createDataFrame(chunks, "run int, chunk int, text string"), "run").collect()}
    assert len(got) == len(claims)
    for run, c, said in claims:
        labels, support, against = [], set(), set()
        for t in T.triplets(said):
            pairs = [(k, judged(t, u)) for r, k, other in chunks if r == run for u in T.triplets(other) if (u["key"], u["predicate"]) == (t["key"], t["predicate"])]
            a, b = {k for k, v in pairs if v == "contradicted"}, {k for k, v in pairs if v == "entailed"}
            labels.append("contradicted" if a else "entailed" if b else "unsupported")
            support, against = support | b, against | a
        label = next((v for v in ("contradicted", "unsupported", "entailed") if v in labels), "abstain")
        assert got[run, c] == (label, sorted(support), sorted(against))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run int, claim int, text string")
    chunks = spark.createDataFrame([(1, 1, "The plan costs $5.")], "run int, chunk int, text string")
    assert T.verified(none, chunks, "run").count() == 0
    one = T.verified(spark.createDataFrame([(1, 1, None)], "run int, claim int, text string"), chunks.limit(0), "run").first()
    assert (one.label, one.n_triplets) == ("abstain", 0)


def test_only_sentences_with_a_verbs_word_are_searched(monkeypatch):
    seen, clauses = [], T.clauses
    monkeypatch.setattr(T, "clauses", lambda s, at: seen.append(s) or clauses(s, at))
    got = T.triplets("No verb here at all. The plan Costs $4. See No. 7 of history.\nAcme uſes maps.")
    assert [(t["subject"], t["predicate"], t["object"]) for t in got] == [("The plan", "cost", "$4"), ("Acme", "use", "maps")]
    plain = [T.triplets(x) and x for x in ("Nothing. The theses of history.", "It must. We must have it.")]
    assert plain[1] and not plain[0] and "Nothing." not in seen and " The theses of history." not in seen
