"""Claims as triplets: subject, predicate, object, qualifiers and values with their spans, and their verification by the chunks' own triplets.

A clause grammar reads the sentence: a predicate is a verb phrase of a fixed table, the subject is the noun phrase before it, the object runs to the
clause's end. A clause after a comma or a
conjunction that has no subject of its own shares the last one; a relative clause's verb is passed over. Extraction runs in Arrow batches (spans need places); all else is joins.

Verification joins a run's claim triplets with its chunks' on run, subject and predicate, all in normal form. A pair whose polarity differs or whose values of one kind differ
contradicts; one that holds all words of the object and all values entails; others neither. A triplet's label is contradicted, entailed or
unsupported in that order of pairs; a claim without triplets abstains. A claim's label is the gravest of its triplets': contradicted, abstain,
unsupported, entailed.

Null and empty texts have no triplets. Texts of any length are read whole. Keys are run, subject and predicate: a common pair of them in one run is a bounded
part of that run, and equal (subject, predicate, object, negated, values) of a run's chunks are folded before the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verb phrases by their normal form; the longest phrase at a place counts.
PREDICATES = {
    "be": ("is", "are", "was", "were", "be", "been"),
    "have": ("has", "have", "had", "includes", "include", "included", "contains", "contain", "contained", "holds", "hold", "held", "comprises"),
    "cost": ("costs", "cost", "is priced at", "are priced at"),
    "require": ("requires", "require", "required", "needs", "need", "must have"),
    "allow": ("allows", "allow", "allowed", "permits", "permit", "permitted"),
    "prohibit": ("prohibits", "prohibit", "prohibited", "forbids", "forbid", "forbidden"),
    "apply": ("applies to", "apply to", "applied to", "covers", "cover", "covered"),
    "start": ("starts", "start", "started", "begins", "begin", "began", "takes effect", "comes into force"),
    "end": ("ends", "end", "ended", "expires", "expire", "expired"),
    "provide": ("provides", "provide", "provided", "offers", "offer", "offered", "gives", "give", "gave", "given"),
    "sanction": ("sanctions", "sanction", "sanctioned", "approves", "approve", "approved", "grants", "grant", "granted"),
    "replace": ("replaces", "replace", "replaced", "supersedes", "supersede", "superseded", "amends", "amend", "amended"),
    "found": ("founded", "established", "created", "launched"),
    "lead": ("leads", "lead", "led", "heads", "headed", "manages", "manage", "managed"),
    "pay": ("pays", "pay", "paid", "reimburses", "reimburse", "reimbursed"),
    "locate": ("is located in", "are located in", "is based in", "are based in"),
    "cause": ("causes", "cause", "caused", "leads to", "lead to", "results in", "result in", "resulted in"),
    "say": ("states", "stated", "says", "said", "reports", "reported"),
    "sell": ("sells", "sell", "sold", "ships", "ship", "shipped"),
    "use": ("uses", "use", "used"),
}
FORMS = {phrase: norm for norm, phrases in PREDICATES.items() for phrase in phrases}
BE = ("is", "are", "was", "were", "be", "been")
NEGATION = r"(?:not|never|no longer)"


def either(phrases) -> str:
    """Alternatives by their first letter, so that a word is held against few of them; the longest of a letter first."""
    by: dict[str, list[str]] = {}
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        by.setdefault(p[0], []).append(re.escape(p[1:]))
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items())


_ANY = either(FORMS)
_ACTION = either(p for p in FORMS if p not in BE and " " not in p)
#: A verb phrase, with a form of "be" and a participle taken as a passive of its own.
VERB = re.compile(rf"\b(?:(?!must\s+have\b)(?:does|do|did|will|shall|can|could|would|may|must)\s+)?(?P<no>{NEGATION}\s+|cannot\s+)?(?:(?P<be>is|are|was|were|be|been)\s+(?P<mid>{NEGATION}\s+)?(?P<part>{_ACTION})|(?P<verb>{_ANY}))\b(?P<after>\s+{NEGATION}\b)?", re.I)
QUALIFIER = re.compile(r"\b(?:effective from|with effect from|up to|not exceeding|subject to|only for|only if|per (?:day|month|year|person|family)|in respect of|provided that|unless|except for|within)\b", re.I)
VALUE = re.compile(r"(?P<money>[$€£₹]\s?\d[\d,]*(?:\.\d+)?)|(?P<percent>\d+(?:\.\d+)?\s?(?:%|percent))|(?P<date>\b(?:19|20)\d\d-\d\d-\d\d\b)|(?P<duration>\b\d+\s(?:day|week|month|year|hour|minute)s?\b)|(?P<year>\b(?:19|20)\d\d\b)|(?P<number>\b\d[\d,]*(?:\.\d+)?\b)", re.I)
SENTENCE = re.compile(r"(?:[^.!?\n;]+|" + "|".join(rf"(?<=\b{a})\." for a in ("No", "Nos", "Dr", "Mr", "Mrs", "Ms", "St", "vs", "etc")) + r"|\.(?=[\dA-Za-z]))+[.!?\n;]?")
#: Every verb phrase begins with one of these words; a sentence without any is not searched for phrases.
FIRST = {phrase.split()[0] for phrase in FORMS}
WORD = re.compile(r"\w+")
#: Letters that equal s, k and i where case is ignored, but not once lowered.
ODD = re.compile("[\u017f\u212a\u0130\u0131]")
PLAIN = str.maketrans("\u017f\u212a\u0130\u0131", "skii")
RELATIVE = re.compile(r"\b(?:that|which|who|whose)\b", re.I)
BREAK = re.compile(r",|;|\s+(?:and|or|but|while|whereas|because|although)\s+", re.I)
ARTICLES = {"the", "a", "an", "this", "that", "these", "those", "its", "their", "his", "her", "our", "all", "any", "of", "to", "for", "in", "on", "at", "by", "with", "from"}
TRIPLET = "struct<subject:string,predicate:string,object:string,negated:boolean,qualifiers:array<string>,values:array<struct<kind:string,value:string>>,start:int,end:int,key:string,words:array<string>>"
ARROW = pa.list_(pa.struct([
    ("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("negated", pa.bool_()), ("qualifiers", pa.list_(pa.string())), ("values", pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))),
    ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("words", pa.list_(pa.string())),
]))
LABELS = ("contradicted", "abstain", "unsupported", "entailed")


def normal(phrase: str) -> list[str]:
    """A phrase's words in lower case without articles and prepositions, plurals cut."""
    words = re.findall(r"[a-z0-9À-ÿ]+", phrase.lower())
    return [w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w for w in words if w not in ARTICLES]


def values_of(text: str) -> list[dict]:
    """Values by kind, in normal form."""
    out = []
    for m in VALUE.finditer(text):
        raw = re.sub(r"[\s,]", "", m.group().lower()).replace("percent", "%")
        out.append({"kind": m.lastgroup, "value": raw.rstrip("s") if m.lastgroup == "duration" else raw})
    return out


def triplets(text: str | None) -> list[dict]:
    """The triplets of a text, sentence by sentence, with the places of their clauses."""
    text = text or ""
    odd = ODD.search(text) is not None
    return [t for s in SENTENCE.finditer(text) if odd or not FIRST.isdisjoint(WORD.findall(s.group().lower())) for t in clauses(s.group(), s.start())]


def clauses(sentence: str, offset: int) -> Iterator[dict]:
    """One triplet for each clause: the first verb after a break, or after the sentence's beginning, that is not a relative clause's."""
    breaks = [(b.start(), b.end()) for b in BREAK.finditer(sentence)]
    verbs: list[tuple[re.Match, int]] = []  # a verb and where its clause begins
    for v in VERB.finditer(sentence):
        if sentence[max(0, v.start() - 12) : v.start()].lower().rstrip().endswith((" that", " which", " who")):
            continue
        since = verbs[-1][0].end() if verbs else 0
        begins = [e for s, e in breaks if since <= s and e <= v.start()]
        if verbs and not begins:
            continue  # a second verb of the same clause belongs to its object
        verbs.append((v, begins[-1] if verbs else 0))
    subject, subject_at = "", 0
    for i, (v, begin) in enumerate(verbs):
        own = sentence[begin : v.start()]
        if own.strip(" ,'\""):
            subject = RELATIVE.split(own)[0].strip(" ,:'\"\t")
            subject_at = begin + own.find(subject)
        elif not subject:
            continue
        nexts = [s for s, e in breaks if i + 1 < len(verbs) and e == verbs[i + 1][1]]
        stop = nexts[0] if nexts else len(sentence)
        rest = sentence[v.end() : stop].rstrip(" .!?;,\n")
        key, said = normal(subject), rest.strip()
        passive = v["part"] is not None
        if not key or not (said or passive):
            continue
        first = QUALIFIER.search(said)
        obj = said[: first.start()].strip(" ,") if first and said[: first.start()].strip(" ,") else said
        verb = FORMS[re.sub(r"\s+", " ", (v["part"] or v["verb"]).translate(PLAIN).lower())]
        yield {
            "subject": subject, "predicate": f"be {verb}" if passive else verb, "object": obj, "negated": any(v[g] for g in ("no", "mid", "after")), "qualifiers": [q.group().lower() for q in QUALIFIER.finditer(said)],
            "values": values_of(said), "start": offset + subject_at, "end": offset + v.end() + len(rest), "key": " ".join(key), "words": sorted(set(normal(VALUE.sub(" ", obj)))),
        }


def extracted(rows: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """``by`` and one row for each triplet of ``text``: ``at`` (from 0) and ``t``."""
    schema = rows.select(*by, F.expr(f"CAST(NULL AS array<{TRIPLET}>)").alias("ts")).schema

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = pa.array([triplets(t) for t in part.column(part.num_columns - 1).to_pylist()], ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], schema.names)

    return rows.select(*by, F.col(text)).mapInArrow(run, schema).select(*by, F.posexplode("ts").alias("at", "t"))


def pair_label(claim: Column, chunk: Column) -> Column:
    """What a chunk's triplet with the same subject and predicate says of a claim's: contradicted, entailed or null."""
    mine, other = claim["values"], chunk["values"]
    kinds = lambda v: F.transform(v, lambda x: x["kind"])
    same_kind = F.arrays_overlap(kinds(mine), kinds(other))
    common = F.size(F.array_intersect(claim["words"], chunk["words"]))
    about = (F.size(claim["words"]) == 0) | (F.size(chunk["words"]) == 0) | (common > 0)
    held = F.size(F.array_except(mine, other)) == 0
    clash = F.exists(mine, lambda x: F.exists(other, lambda y: x["kind"] == y["kind"]) & ~F.exists(other, lambda y: (x["kind"] == y["kind"]) & (x["value"] == y["value"])))
    whole = F.size(F.array_except(claim["words"], chunk["words"])) == 0
    return (
        F.when((claim["negated"] != chunk["negated"]) & whole & (held | ~same_kind), "contradicted")
        .when((claim["negated"] == chunk["negated"]) & about & clash & ~claim["negated"], "contradicted")
        .when((claim["negated"] == chunk["negated"]) & whole & held, "entailed")
    )


def verified(claims: DataFrame, chunks: DataFrame, *by: str, claim: str = "claim", chunk: str = "chunk") -> DataFrame:
    """One row a claim: its label, how many triplets it has, and the chunks that entail and that contradict it.

    ``claims`` (run columns, ``claim``, ``text``) and ``chunks`` (run columns, ``chunk``, ``text``) meet on run, subject and predicate.
    """
    mine = extracted(claims, *by, claim).withColumn("key", F.col("t")["key"]).withColumn("predicate", F.col("t")["predicate"])
    theirs = extracted(chunks, *by, chunk).select(*by, chunk, F.col("t")["key"].alias("key"), F.col("t")["predicate"].alias("predicate"), F.struct("t.negated", "t.values", "t.words").alias("u"))
    folded = theirs.groupBy(*by, "key", "predicate", "u").agg(F.array_sort(F.collect_set(chunk)).alias("from"))
    pairs = mine.join(folded, [*by, "key", "predicate"], "left").withColumn("label", F.when(F.col("u").isNotNull(), pair_label(F.col("t"), F.col("u"))))
    of = lambda label: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("label") == label, F.col("from")))))
    each = pairs.groupBy(*by, claim, "at").agg(of("contradicted").alias("against"), of("entailed").alias("backed"))
    label = F.when(F.size("against") > 0, "contradicted").when(F.size("backed") > 0, "entailed").otherwise("unsupported")
    each = each.withColumn("label", label)
    grave = lambda v: F.max((F.col("label") == v).cast("int")) == 1
    whole = each.groupBy(*by, claim).agg(
        F.count(F.lit(1)).alias("n_triplets"), F.when(grave("contradicted"), "contradicted").when(grave("unsupported"), "unsupported").otherwise("entailed").alias("label"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("backed")))).alias("supporting"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("against")))).alias("contradicting"),
    )
    out = claims.select(*by, claim).distinct().join(whole, [*by, claim], "left")
    return out.withColumns({"n_triplets": F.coalesce("n_triplets", F.lit(0)).cast("long"), "label": F.coalesce("label", F.lit("abstain"))})
