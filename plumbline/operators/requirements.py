"""What a question asks for, which chunks hold it, the fewest chunks that hold all of it, and what is missing.

Tables: requirements are rows (run, ``req``, ``terms``), chunks are rows (run, ``rank``, ``chunk``, ``terms``). Both meet on run and
term, so no requirement is compared with a chunk that shares nothing with it. The same rules are expressions over nested rows
(``covered``, ``least_cover``) for plans that keep a run in one row.

Null or empty questions ask for nothing; a requirement without terms is missing; runs without chunks miss everything; chunks that share a
requirement's best ratio all count, in order of rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as W

#: Where a question falls apart into what it asks for.
PARTS = r"(?i)[?!;\n]+|\.\s+|,\s+and\s+|,\s+|\s+and\s+(?=(?:what|when|where|who|which|how|why|is|are|does|do|can|list|name|give)\b)|\s+as well as\s+"
def word(these: str) -> str:
    """A pattern of whole words, whatever their case; letters with accents are letters, too."""
    return rf"(?i)(?:^|[^A-Za-z0-9_À-ɏ])(?:{these})(?:$|[^A-Za-z0-9_À-ɏ])"


#: The kind of a requirement, the first that fits.
KINDS = (
    (word("source|sources|cite|citation|reference|document|section|table|figure"), "required_source_or_citation"),
    (word("compare|compared|versus|vs|than|difference|better|worse|baseline"), "required_comparison_baseline"),
    (word("except|exception|exceptions|unless|exclude|excluded|exclusion|limit|limits|limitation|caveat"), "required_exception_or_limitation"),
    (word("how to|how do|how can|steps?|procedure|process|install|configure|apply"), "required_step_or_procedure"),
    (word("why|cause|causes|caused|reason|reasons|because|effect|effects"), "required_causal_support"),
    (word("when|date|deadline|until|since|expire|expires|effective|duration|(?:19|20)[0-9][0-9]"), "required_date_or_time"),
    (word("how many|how much|amount|price|cost|fee|rate|percent|percentage|number|total|size|version") + "|[$%]", "required_value"),
    (word("if|for|under|within|only|eligible|applies|condition|conditions|scope|region|plan"), "required_condition_or_scope"),
    (word("who|which|what|name"), "required_entity"),
)
DEFAULT_KIND = "required_condition_or_scope"
OPTIONAL = word("if possible|optionally|ideally|nice to have")
SUPPORTING = word("also|additionally|example|examples|background|context")
COVERED, PARTIAL = 0.5, 0.25
#: Words whose change of place shows that a retrieval drifted: fixed values.
DRIFT_TERMS = (
    "office", "park", "parks", "public", "school", "education", "higher", "telangana", "ap", "jurisdiction", "state", "federal", "domestic", "international", "online", "store", "in-store", "current", "2024", "2025", "2026",
)


def parts(query: Column | str) -> Column:
    """The pieces of a question that hold a content term each, in order."""
    pieces = F.transform(F.split(query, PARTS), lambda p: F.trim(p))
    return F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.size(W.terms(p)) > 0)


def kind(part: Column) -> Column:
    out = F
    for pattern, name in KINDS:
        out = out.when(part.rlike(pattern), name)
    return out.otherwise(DEFAULT_KIND)


def importance(part: Column) -> Column:
    return F.when(part.rlike(OPTIONAL), "optional").when(part.rlike(SUPPORTING), "supporting").otherwise("critical")


def asked(query: Column | str) -> Column:
    """A question's requirements: array of (req, description, kind, importance, terms), numbered from 1."""
    return F.transform(parts(query), lambda p, i: F.struct((i + 1).alias("req"), p.alias("description"), kind(p).alias("kind"), importance(p).alias("importance"), W.terms(p).alias("terms")))


def required(runs: DataFrame, *by: str, query: str = "query") -> DataFrame:
    """The requirements of each run as rows."""
    return runs.select(*by, F.explode(asked(query)).alias("r")).select(*by, "r.*")


def status(ratio: Column) -> Column:
    return F.when(ratio > COVERED, "covered").when(ratio >= PARTIAL, "partial").otherwise("missing")


def coverage(requirements: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """One row a requirement: the best share of its terms that a chunk holds, all chunks with that share, terms that they hold together and terms missed.

    Requirements and chunks meet on run and term. Only a requirement's own best chunks are listed.
    """
    asks = requirements.select(*by, "req", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    holds = chunks.select(*by, "rank", "chunk", F.explode(F.array_distinct("terms")).alias("term"))
    hits = asks.join(holds, [*by, "term"]).groupBy(*by, "req", "rank", "chunk").agg((F.count(F.lit(1)) / F.max("n")).alias("ratio"), F.collect_list("term").alias("held"))
    # all ties of the best ratio come out of one aggregate: a list for each ratio, the highest ratio's list last
    levels = hits.groupBy(*by, "req", "ratio").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("ties"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    best = levels.groupBy(*by, "req").agg(F.max_by(F.struct("ratio", "ties", "held"), "ratio").alias("best"))
    out = requirements.join(best, [*by, "req"], "left").withColumn("ratio", F.coalesce(F.col("best")["ratio"], F.lit(0.0)))
    none = F.array().cast("array<string>")
    held = F.coalesce(F.col("best")["held"], none)
    ids = F.coalesce(F.transform(F.col("best")["ties"], lambda t: t["chunk"]), F.array().cast(f"array<{chunks.schema['chunk'].dataType.simpleString()}>"))
    return out.select(
        *requirements.columns, "ratio", status(F.col("ratio")).alias("status"), F.when(F.col("ratio") >= PARTIAL, ids).otherwise(F.slice(ids, 1, 0)).alias("chunks"),
        F.array_sort(F.array_intersect("terms", held)).alias("matched"), F.array_sort(F.array_except("terms", held)).alias("missed"),
    )


def covered(requirements: Column, chunk_terms: Column) -> Column:
    """``coverage`` over one nested row: (req, ratio, status, places of the best chunks from 0, matched, missed) of each requirement; ``chunk_terms`` is an array of term arrays."""

    def one(r: Column) -> Column:
        ratios = F.transform(chunk_terms, lambda t: F.coalesce(W.overlap(r["terms"], t), F.lit(0.0)))
        best = F.coalesce(F.array_max(ratios), F.lit(0.0))
        places = F.filter(F.transform(ratios, lambda x, i: F.when((x == best) & (x > 0), i)), lambda i: i.isNotNull())
        held = F.flatten(F.transform(places, lambda i: F.get(chunk_terms, i)))
        return F.struct(
            r["req"].alias("req"), best.alias("ratio"), status(best).alias("status"), F.when(best >= PARTIAL, places).otherwise(F.slice(places, 1, 0)).alias("places"),
            F.array_sort(F.array_intersect(r["terms"], held)).alias("matched"), F.array_sort(F.array_except(r["terms"], held)).alias("missed"),
        )

    return F.transform(requirements, one)


def support(covered_rows: DataFrame, *by: str) -> DataFrame:
    """One row a run: its requirements, those that no chunk covers, and its chunks with the requirements that each covers."""
    holds = covered_rows.where("status = 'covered'").select(*by, "req", F.explode("chunks").alias("chunk")).groupBy(*by, "chunk").agg(F.array_sort(F.collect_set("req")).alias("reqs"))
    lists = holds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk", "reqs"))).alias("holds"))
    base = covered_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("status") == "covered", F.col("req")))).alias("can"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "covered", F.col("req")))).alias("uncovered"),
        F.array_sort(F.collect_list(F.when((F.col("status") == "missing") & (F.col("importance") == "critical"), F.col("req")))).alias("critical"),
    )
    return base.join(lists, list(by), "left")


def least_cover(holds: Column, can: Column) -> Column:
    """Chunks chosen greedily until all of ``can`` is held: each time the one that holds most of what is left, the first of several. ``holds`` is a sorted array of (chunk, reqs)."""
    start = F.struct(can.alias("left"), F.transform(F.slice(holds, 1, 0), lambda h: h["chunk"]).alias("chosen"))

    def step(state: Column, _: Column) -> Column:
        gain = F.transform(holds, lambda h, i: F.struct(F.size(F.array_intersect(h["reqs"], state["left"])).alias("gain"), (-i).alias("first"), h.alias("h")))
        best = F.array_max(gain)
        return F.when((F.size(state["left"]) == 0) | (best["gain"] == 0), state).otherwise(
            F.struct(F.array_except(state["left"], best["h"]["reqs"]).alias("left"), F.concat(state["chosen"], F.array(best["h"]["chunk"])).alias("chosen"))
        )

    return F.when(F.size(holds) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(can), F.lit(1))), start, step)["chosen"])


def evidence_lists(claims: Column, verdicts: Column, chunk_ids: Column) -> Column:
    """Of a run's claims: whether the evidence suffices, claims without any evidence, claims affected, and all chunks that a verdict names."""
    both = F.arrays_zip(claims.alias("claim"), verdicts.alias("v"))
    lacking = F.filter(both, lambda x: (x["v"]["label"] == "unsupported") & (F.size(x["v"]["supporting"]) == 0))
    affected = F.filter(both, lambda x: ((x["v"]["label"] == "unsupported") & (F.size(x["v"]["supporting"]) == 0)) | (x["v"]["label"] == "contradicted"))
    places = F.flatten(F.transform(verdicts, lambda v: F.concat(v["supporting"], v["candidates"], v["contradicting"])))
    return F.struct(
        (F.size(lacking) == 0).alias("sufficient"), F.transform(lacking, lambda x: x["claim"]).alias("missing_evidence"), F.transform(affected, lambda x: x["claim"]).alias("affected_claims"),
        F.array_sort(F.array_distinct(F.transform(places, lambda i: F.get(chunk_ids, i)))).alias("evidence_chunks"),
    )


def drift(query_terms: Column, text_terms: Column, words=DRIFT_TERMS) -> Column:
    """Shared, missing and strange terms of a question and its chunks, their shares, and whether the retrieval drifted to another scope."""
    own = F.array(*map(F.lit, words))
    shared, missing, strange = F.array_intersect(query_terms, text_terms), F.array_except(query_terms, text_terms), F.array_except(text_terms, query_terms)
    match, away = F.size(shared) / F.greatest(F.size(query_terms), F.lit(1)), F.size(strange) / F.greatest(F.size(text_terms), F.lit(1))
    both = F.arrays_overlap(missing, own) & F.arrays_overlap(strange, own)
    fail = (F.size(shared) > 0) & both & (match <= 0.75) & (away >= 0.25)
    return F.struct(F.array_sort(shared).alias("shared"), F.array_sort(missing).alias("missing"), F.array_sort(strange).alias("strange"), match.alias("match"), away.alias("drift"), F.when(fail, "fail").otherwise("pass").alias("status"))
