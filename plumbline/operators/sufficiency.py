"""Whether the context suffices for a query: the first rung that holds, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as W

# Fixed values.
CURRENT = r"(?i)\b(current|latest|now|today|recent|newest|present)\b"
OLD = r"(?i)\bas of \d{4}\b|\bsince \d{4}\b|\bdated? \d{4}\b|\b\(\s*\d{4}\s*\)"
TEMPORAL = r"(?i)\b(current|latest|effective|updated|version|versions|before|after|since|until|during|when)\b|\b(?:19|20)\d{2}\b"
TIMED = r"(?i)\b(?:19|20)\d{2}\b|\b(?:effective|updated|version|rev\.?|revision|release)\b"
CRITICAL = r"(?i)\b(safe|safety|dangerous|danger|hazard|hazardous|toxic|poison|poisonous|risk|risky)\b"
EVERYONE = r"(?i)\b(?:all|every|any|everyone)\s+(\w+)\b"
QUALIFIER = (
    r"(?i)(?:^|[^\w-])(full-time|fulltime|full_time|part-time|parttime|contract|permanent|temporary|senior|junior|certain|specific|only|eligible|qualified|authorized|"
    r"washable|standard|premium|legacy|beta|experimental)(?:[^\w-]|$)"
)
CONDITION = r"(?i)\bif\s+(?:(?:i|you|we|they)\s+)?(\w+)\b"
SKIPPED = "need want can could have had get do would should must might may will shall be is are was were has not no any more".split()
PLACE = r"\bin ([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky",
    "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york",
    "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
)
ANCHOR = r"\b((?:Project|Tool|Product)\s+[A-Z0-9])\b"
LISTS = r"(?i)\b(list|requirements?|include)\b"
#: A place name's surroundings in which the answer's words are looked for.
AROUND = 80


def long_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\w.%-]+"), F.lit(0)), lambda w: F.length(w) > 3)


def hidden_scope(query: Column, context: Column, answer: Column) -> Column:
    """Whether the answer draws on a passage that holds in one state only, which neither query nor answer names."""
    low = F.lower(context)
    places = F.array_distinct(F.transform(F.regexp_extract_all(context, F.lit(PLACE), F.lit(1)), F.lower))
    unnamed = F.filter(places, lambda p: p.isin(*STATES) & ~F.contains(F.lower(query), p) & ~F.contains(F.lower(answer), p))
    own = long_tokens(answer)

    def drawn(p: Column) -> Column:
        # every passage around "in <place>": the pieces between mentions, cut to the window on both sides
        pieces = F.split(low, F.concat(F.lit(r"\bin "), p, F.lit(r"\b")))
        before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.substring(x, F.greatest(F.length(x) - AROUND + 1, F.lit(1)), F.lit(AROUND)))
        after = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.substring(x, F.lit(1), F.lit(AROUND)))
        return F.arrays_overlap(own, F.array_remove(long_tokens(F.array_join(F.concat(before, after), " ")), p))

    return F.exists(unnamed, drawn)


def omitted(query: Column, context: Column, answer: Column) -> Column:
    """Terms of a query for a list that the context holds and the answer lacks."""
    low = F.lower(query)
    tail = F.when(F.contains(low, F.lit(":")), F.regexp_extract(low, r"^[^:]*:(?s)(.*)$", 1)).otherwise(low)
    wanted = F.array_except(W.terms(tail), F.array(*map(F.lit, ("list", "requirement", "requirements", "include"))))
    return F.when(query.rlike(LISTS), F.array_except(F.array_intersect(wanted, W.terms(context)), W.terms(answer))).otherwise(F.array().cast("array<string>"))


def sufficiency(query: Column, context: Column, answer: Column, *, least: float = 0.3) -> Column:
    """(status, failure type, stage, reason)."""
    q, c = W.terms(query), W.terms(context)
    cover = F.coalesce(W.overlap(q, c), F.lit(0.0))
    everyone, condition = F.lower(F.regexp_extract(query, EVERYONE, 1)), F.lower(F.regexp_extract(query, CONDITION, 1))
    low = F.lower(context)
    missing = F.filter(F.regexp_extract_all(query, F.lit(ANCHOR), F.lit(1)), lambda a: ~F.contains(low, F.lower(a)))
    thin = (F.size(missing) > 0) | (cover < least)
    out = lambda status, failure, reason, stage="SUFFICIENCY": F.struct(
        F.lit(status).alias("status"), F.lit(failure).cast("string").alias("failure_type"), F.lit(stage).alias("stage"), F.lit(reason).alias("reason")
    )
    short = "INSUFFICIENT_CONTEXT"
    return (
        F.when(query.rlike(CURRENT) & context.rlike(OLD), out("fail", "STALE_RETRIEVAL", "stale_context_mistaken_as_sufficient", "RETRIEVAL"))
        .when(query.rlike(TEMPORAL) & ~context.rlike(TIMED), out("fail", short, "missing_temporal_or_freshness_requirement"))
        .when((F.length(condition) > 3) & ~condition.isin(*SKIPPED, *W.STOP) & ~F.contains(low, condition), out("fail", short, "partial_requirement_coverage"))
        .when((everyone != "") & F.contains(low, everyone) & context.rlike(QUALIFIER), out("fail", short, "missing_exception"))
        .when(hidden_scope(query, context, answer), out("fail", short, "missing_scope_condition"))
        .when(F.size(q) == 0, out("skip", None, "no_query_terms"))
        .when((F.size(missing) == 0) & (F.size(omitted(query, context, answer)) > 0), out("fail", short, "answer_omits_requirements", "GENERATION"))
        .when(thin & query.rlike(CRITICAL), out("fail", short, "missing_critical_requirement"))
        .when(thin, out("fail", short, "low_coverage"))
        .otherwise(out("pass", None, "covered"))
    )


#: Reasons that are explicit roots; the others are of coverage alone.
STRUCTURED = ("stale_context_mistaken_as_sufficient", "missing_temporal_or_freshness_requirement", "partial_requirement_coverage", "missing_exception", "missing_scope_condition", "missing_critical_requirement")
