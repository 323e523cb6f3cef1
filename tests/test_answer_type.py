import re

from plumbline.plans import catalogue

MONTHS = "jan feb mar apr may jun jul aug sep sept oct nov dec".split()


def judged(query, answer):
    """The kinds a question can ask for, in order; phrases count wherever they stand."""
    q = query.lower()
    has = lambda *phrases: any(p in q for p in phrases)
    ok = lambda x: "match" if x else "mismatch"
    if has("how many", "what number", "count"):
        return ok(re.search(r"\b\d+\b", answer))
    if has("when", "what date", "what year"):
        return ok(re.search(r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4})\b", answer) or any(w.startswith(m) for w in re.findall("[a-z]+", answer.lower()) for m in MONTHS))
    if has("who", "whose", "where"):
        return ok(re.search(r"\b[A-Z][a-z]+", answer))
    if has("yes or no", "is it", "does it"):
        return ok(answer.lower().startswith(("yes", "no")))
    return "uncertain"


def test_every_question_is_judged(spark, tmp_path):
    asked = [
        ("When was it built?", "in 1987"), ("When was it built?", "on 3/4"), ("Since when?", "In MAY, i think"), ("What date?", "on 3/4/2020"), ("When?", "long ago"), ("Who wrote it?", "it was Ada"), ("Who wrote it?", "nobody knows"),
        ("Where is it?", "it is near Paris"), ("Where is it?", "over there"), ("How many, and when?", "7"), ("How many?", "some"), ("Is it open?", "Yes."), ("Is it open?", "maybe"), ("Tell me more", "ok"),
    ]
    turns = [(i, k, role, t) for i, pair in enumerate(asked) for k, (role, t) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.verdict for r in catalogue.QUERIES["answer_type"](spark, str(tmp_path)).where("conv_id >= 0").collect()}
    assert got == {i: judged(q, a) for i, (q, a) in enumerate(asked)}
