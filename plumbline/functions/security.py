"""Guards around the injection bank: documentation context, encoded text and intent by nearby words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as W

FENCE = "```"
#: Phrases near a match in documentation, words of decoded and of split injections, (class, verbs, objects) that show an intent within ten words.
SAFE_PHRASES = r"(?i)(uses the|the model uses|delimiter is|token is|example:|syntax:|format:|mark sequence|represents a)"
ENCODED_KEYWORDS = r"(?i)(ignore|system prompt|api key|password|secret|token|override|bypass)"
SPLIT_KEYWORDS = r"(?i)(ignore|system|reveal|send|password|instruction|override)"
CONCEPTS = (
    (
        "override",
        ("override", "ignore", "disregard", "set_aside", "forget", "dismiss", "skip", "bypass", "cancel", "undo", "revoke", "reset"),
        ("instruction", "instructions", "parameter", "parameters", "guideline", "guidelines", "rule", "rules", "constraint", "constraints", "directive", "directives", "policy", "policies", "context", "prompt", "prior", "previous", "earlier"),
    ),
    (
        "role",
        ("become", "transform", "switch", "change", "act", "pretend", "roleplay", "simulate", "impersonate", "adopt"),
        ("role", "persona", "identity", "character", "mode", "version", "assistant", "agent", "system"),
    ),
    (
        "exfiltration",
        ("send", "transmit", "forward", "share", "reveal", "disclose", "expose", "leak", "output", "print", "return", "export"),
        ("key", "secret", "token", "password", "credential", "credentials", "prompt", "instruction", "instructions", "configuration", "config", "api", "system"),
    ),
)
JOINED = 5
NEAR = 10
PROXIMITY = 0.72


def decoded(text: Column, keywords: str = ENCODED_KEYWORDS) -> Column:
    """Whether a run of base64 characters decodes to text with a keyword; what does not decode counts as nothing."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0))
    whole = F.transform(runs, lambda r: F.substring(r, F.lit(1), (F.length(r) - F.length(r) % 4)))
    return F.exists(whole, lambda r: F.coalesce(F.try_to_binary(r, F.lit("base64")).cast("string").rlike(keywords), F.lit(False)))


def negations(tok: Column) -> Column:
    """Places of not, never, cannot and "no longer" in a token array, from 0."""
    hit = lambda t, i: t.isin("not", "never", "cannot") | ((t == "no") & F.coalesce(F.get(tok, i + 1) == "longer", F.lit(False)))
    return F.array_compact(F.transform(tok, lambda t, i: F.when(hit(t, i), i)))


def window(tok: Column, i: Column, reach: int) -> Column:
    return F.slice(tok, F.greatest(i + 1 - reach, F.lit(1)), F.least(i, F.lit(reach)) + reach + 1)


def denied(tok: Column, terms: Column, reach: int = 5) -> Column:
    """The largest set of the terms around one negation, the first of several."""
    return F.aggregate(negations(tok), F.array().cast("array<string>"), lambda best, i: F.when(F.size(F.array_intersect(terms, window(tok, i, reach))) > F.size(best), F.array_intersect(terms, window(tok, i, reach))).otherwise(best))


def asserted(tok: Column, terms: Column, reach: int = 16) -> Column:
    """Whether all terms stand around one of them without a negation there."""
    at = F.array_compact(F.transform(tok, lambda t, i: F.when(F.array_contains(terms, t), i)))
    clear = lambda i: ~F.exists(negations(tok), lambda k: F.abs(k - i) <= reach)
    return F.exists(at, lambda i: (F.size(F.array_except(terms, window(tok, i, reach))) == 0) & clear(i))


STOP_DENIAL = [*W.STOP_INCONSISTENCY, "not", "never", "cannot", "no", "longer"]


def contradicts(a: Column, b: Column) -> Column:
    """``opposed`` of two texts."""
    return opposed(W.tokens(a), W.tokens(b))


def opposed(a: Column, b: Column) -> Column:
    """Whether two token arrays share two or more content terms that one denies and the other asserts, in either direction."""
    shared = F.array_except(F.array_intersect(a, b), F.array(*map(F.lit, STOP_DENIAL)))

    def one(x: Column, y: Column) -> Column:
        # the denied terms are computed once and handed on as the only element of an array
        return F.exists(F.filter(F.array(denied(x, shared)), lambda d: F.size(d) >= 2), lambda d: asserted(y, d))

    says = lambda x: F.exists(x, lambda t: t.isin("not", "never", "cannot", "no"))
    return (says(a) & one(a, b)) | (says(b) & one(b, a))


def quoted(text: Column, pattern: str) -> Column:
    """Whether the pattern's first match stands in a closed fence, on a line indented by four spaces, or within 50 characters of a phrase of documentation."""
    at = F.regexp_instr(text, F.lit(pattern))
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    start = F.greatest(at - 50, F.lit(1))
    fences = lambda t: F.size(F.split(t, FENCE)) - 1
    return ((fences(before) % 2 == 1) & (fences(after) > 0)) | before.rlike(r"(^|\n) {4}[^\n]*\z") | F.substring(text, start, at + 50 - start).rlike(SAFE_PHRASES)


def unquoted(text: Column) -> Column:
    """The text with percent codes decoded; a percent sign that begins no code stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")), text)


def any_of(text: Column, bank) -> Column:
    return F.size(W.matches(text, bank)) > 0


def intent(text: Column) -> Column:
    """(class, score) of the first concept whose verb and object are within ten words; null without one."""
    tok = F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\bset[^a-z]+aside\b", "set_aside"), F.lit("set_aside|[a-z]+"), F.lit(0))

    def first(tok: Column) -> Column:
        at = lambda words: F.array_compact(F.transform(tok, lambda t, i: F.when(t.isin(*words), i)))
        out = F
        for name, verbs, objects in CONCEPTS:
            near = F.exists(at(verbs), lambda v: F.exists(at(objects), lambda o: F.abs(v - o) <= NEAR))  # noqa: B023
            out = out.when(near, F.struct(F.lit(name).alias("intent"), F.lit(PROXIMITY).alias("score")))
        return out.otherwise(F.lit(None))

    # the tokens are computed once and handed on as the only element of an array
    return F.get(F.transform(F.array(tok), first), 0)


def paraphrased(text: Column) -> Column:
    return intent(text).isNotNull()


def injected(text: Column, longest: int | None = None) -> Column:
    """Whether a chunk carries an injection: in the open outside documentation, encoded or paraphrased. Chunks of any length are read; ``longest`` leaves out those over so many characters."""
    shown = F.lit(False)
    for pattern, _ in W.INJECTION_ALL:
        shown = shown | (text.rlike(pattern) & ~quoted(text, pattern))
    encoded = decoded(text, ENCODED_KEYWORDS) | (text.rlike("%[0-9A-Fa-f]{2}") & (unquoted(text) != text) & any_of(unquoted(text), W.INJECTION_ALL))
    return ((F.length(text) <= longest) if longest else F.lit(True)) & (shown | encoded | paraphrased(text))


def split_over(chunks: Column) -> Column:
    """The ids of the chunks that share an injection: the first chunks joined hold one and two or more of them a word of it."""
    first = F.slice(chunks, 1, JOINED)
    parts = F.transform(F.filter(first, lambda c: c["text"].rlike(SPLIT_KEYWORDS)), lambda c: c["chunk_id"])
    joined = F.array_join(F.transform(first, lambda c: c["text"]), " ")
    return F.when((F.size(parts) > 1) & any_of(joined, W.INJECTION_ALL), parts).otherwise(F.array().cast("array<string>"))
