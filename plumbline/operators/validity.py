"""Which of a run's sources are valid on a date, and how grave it is where they are not: expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import metadata as M
from plumbline.functions import text as W
from plumbline.operators.sources_of_truth import validity

INVALID = ("superseded", "withdrawn", "expired", "deprecated", "replaced", "not_yet_effective")
DOUBTFUL = ("stale_by_age", "amended", "metadata_missing", "applicability_unknown", "draft", "stale")
LINEAGE = ("withdrawn", "superseded", "replaced", "deprecated", "amended")


def sources(chunks: Column, cited: Column, entries: Column) -> Column:
    """A run's documents, retrieved or cited, once each: doc, text of its chunks, metadata of its first chunk, and its last corpus entry."""
    docs = F.array_distinct(F.concat(F.transform(chunks, lambda c: c["source_doc_id"]), cited))
    own = lambda d: F.filter(chunks, lambda c: c["source_doc_id"] == d)
    return F.transform(docs, lambda d: F.struct(
        d.alias("doc"), F.array_join(F.transform(own(d), lambda c: c["text"]), "\n").alias("text"), F.get(own(d), 0)["metadata"].alias("meta"), F.try_element_at(F.filter(entries, lambda e: e["doc_id"] == d), F.lit(-1)).alias("entry"),
    ))


def assessed(sources_: Column, as_of: Column, *, max_age_days: int = 180) -> Column:
    """Each source with its validity, its date and its successors. Metadata of the corpus comes first, then the chunk's, then what the text says of itself."""

    none = F.array().cast("array<string>")

    def read(s: Column) -> Column:
        """What is said of a source; each value is found once, and the next step reads them."""
        get = lambda f, *keys: F.coalesce(f(s["entry"]["metadata"], *keys), f(s["meta"], *keys))
        silent = (F.coalesce(F.size(s["entry"]["metadata"]), F.lit(0)) < 1) & (F.coalesce(F.size(s["meta"]), F.lit(0)) < 1)
        told = lambda c: F.when(~silent, c)
        by = lambda x: F.coalesce(told(F.array_distinct(F.concat(*(F.coalesce(M.ids(m, f"{x}_by", f"{x}_by_doc_ids", f"lineage.{x}_by"), none) for m in (s["entry"]["metadata"], s["meta"]))))), none)
        return F.struct(
            s["doc"].alias("doc"), s["text"].alias("text"), W.lifecycle_facts(s["text"]).alias("said"), told(F.lower(get(M.value, "status", "lifecycle.status"))).alias("status"),
            told(get(M.date_of, "effective_date", "valid_from")).alias("effective"), told(get(M.date_of, "expiry_date", "valid_to", "valid_until")).alias("expiry"),
            F.coalesce(told(get(M.date_of, "issue_date", "published_at", "updated_at", "date")), s["entry"]["timestamp"].cast("date")).alias("at"), *(by(x).alias(x) for x in LINEAGE),
        )

    def settled(x: Column) -> Column:
        tracked = F.size(F.concat(*(x[n] for n in LINEAGE))) > 0
        return F.struct(*(x[n].alias(n) for n in ("doc", "text", "said", *LINEAGE)), F.coalesce(x["status"], x["said"]["status"]).alias("status"), F.coalesce(x["effective"], x["said"]["effective"]).alias("effective"),
                        F.coalesce(x["expiry"], x["said"]["expiry"]).alias("expiry"), F.coalesce(x["at"], x["said"]["issued"]).alias("at"), tracked.alias("tracked"))

    def judged(x: Column) -> Column:
        hit = lambda n: (F.size(x[n]) > 0) | F.coalesce(x["status"] == n, F.lit(False))
        rung = validity(
            withdrawn=hit("withdrawn"), superseded=hit("superseded"), replaced=hit("replaced"), deprecated=hit("deprecated"), expiry=x["expiry"], effective=x["effective"],
            amended=hit("amended") | F.coalesce(x["status"] == "revised", F.lit(False)), applicable=~F.coalesce(x["status"] == "applicability_unknown", F.lit(False)),
            status=x["status"], at=F.when(~x["tracked"], x["at"]), query_date=as_of.cast("date"), as_of=as_of.cast("date"), max_age_days=max_age_days,
        )
        said = F.when(x["said"]["successor"].isNotNull(), F.array(x["said"]["successor"])).otherwise(none)
        return F.struct(x["doc"].alias("doc"), x["text"].alias("text"), rung.alias("rung"), x["tracked"].alias("tracked"), F.coalesce(x["effective"], x["at"]).alias("date"), F.array_distinct(F.concat(*(x[n] for n in LINEAGE), said)).alias("successors"))

    found = F.transform(F.transform(F.transform(sources_, read), settled), judged)
    state = lambda x: F.when(x["tracked"] & (x["rung"] == "metadata_missing"), "active").otherwise(x["rung"])
    return F.transform(found, lambda x: F.struct(x["doc"].alias("doc"), x["text"].alias("text"), state(x).alias("state"), x["date"].alias("date"), x["successors"].alias("successors")))


SIGNAL = r"\b[A-Z][a-zA-Z0-9_.-]+\b|\b\d+(?:\.\d+)?%?\b"


def severity(found: Column, docs: Column, cited: Column, query: Column, answer: Column, wants_current: Column) -> dict[str, Column]:
    """Document ids by how grave their state is: cited and invalid, answer-bearing and invalid, only retrieved and stale, stale but beside the point."""
    of = lambda keep: F.array_sort(F.transform(F.filter(found, keep), lambda x: x["doc"]))
    is_cited, is_here = (lambda x: F.array_contains(cited, x["doc"])), (lambda x: F.array_contains(docs, x["doc"]))
    invalid, aged = (lambda x: x["state"].isin(*INVALID)), (lambda x: x["state"].isin("stale_by_age", "stale"))
    signals = F.filter(F.regexp_extract_all(answer, F.lit(SIGNAL), F.lit(0)), lambda w: w.rlike("[a-z]|^[0-9]+$"))
    bears = lambda x: is_cited(x) | (F.size(F.array_intersect(W.terms(x["text"]), W.terms(answer))) >= 2) | F.exists(signals, lambda w: F.contains(F.lower(x["text"]), F.lower(w)))
    relevant = lambda x: F.arrays_overlap(W.terms(x["text"]), W.terms(query))
    newer = lambda x: F.exists(found, lambda y: is_here(y) & (y["doc"] != x["doc"]) & (y["date"] > x["date"]))
    fresh = F.exists(found, lambda y: is_here(y) & (y["state"] == "active"))
    bearing = lambda x: (invalid(x) | (aged(x) & wants_current)) & bears(x) & ~(invalid(x) & is_cited(x))
    idle = lambda x: aged(x) & is_here(x) & ~is_cited(x) & ~bearing(x)
    return {
        "cited_invalid": of(lambda x: invalid(x) & is_cited(x)),
        "answer_bearing": of(bearing),
        "retrieved_stale": of(lambda x: idle(x) & F.when(relevant(x), F.coalesce(newer(x), F.lit(False))).otherwise(~fresh)),
        "beside_the_point": of(lambda x: idle(x) & ~relevant(x) & fresh),
        "doubtful": of(lambda x: x["state"].isin(*DOUBTFUL) & is_here(x)),
        "invalid_here": of(lambda x: invalid(x) & is_here(x)),
    }
