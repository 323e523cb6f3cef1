"""Analyzers, hooks, validators and chunkers of one's own, and what happens when one of them fails.

An ``Analyzer`` is a Python function over one run's fields; all of them run in one Arrow-batched call a batch, each inside its own error boundary. One that raises, or returns what is no
result, ends neither the job nor the row: a critical one fails the run as INCOMPLETE_DIAGNOSIS (tier 0 of the policy), any other is skipped with the message. Analyzers that are expressions
(``diagnose``'s ``extra``) run in the JVM and must be total: use ``try_`` functions there.

``Hooks`` replace three judgements that several analyzers share: how relevant a chunk is, whether two chunks contradict each other, whether a corpus entry is stale.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import security
from plumbline.functions import text as W

STATUSES = ("pass", "warn", "fail", "skip")
RISKS = ("NONE", "LOW", "MEDIUM", "HIGH")
#: What an analyzer of one's own may read of a run.
FIELDS = ("run_id", "query", "final_answer", "retrieved_chunks", "cited_doc_ids", "answer_confidence", "corpus_entries", "metadata")
RESULT = "struct<analyzer:string,at:int,weight:double,status:string,failure_type:string,stage:string,score:double,security_risk:string,evidence:array<string>,marks:array<string>>"


@dataclass(frozen=True)
class Analyzer:
    """``run`` takes a dict of ``FIELDS`` and returns a dict with ``status`` and, as fits, ``failure_type``, ``score``, ``security_risk``, ``evidence`` and ``marks``; None is a skip."""

    name: str
    run: Callable[[dict], dict | None]
    stage: str = "UNKNOWN"
    weight: float = 1.0
    critical: bool = False


@dataclass(frozen=True)
class Hooks:
    """Judgements as column functions: ``relevance`` of (query terms, chunk terms) from 0 to 1, ``contradiction`` of two token arrays, ``stale`` of (entry, time)."""

    relevance: Callable[[Column, Column], Column] = field(default=lambda q, t: F.coalesce(W.overlap(q, t), F.lit(0.0)))
    contradiction: Callable[[Column, Column], Column] = field(default=security.opposed)
    stale: Callable[[Column, Column], Column] = field(default=lambda entry, as_of: entry["timestamp"] < as_of - F.expr("INTERVAL 180 DAYS"))


def checked(analyzer: Analyzer, at: int, out: dict | None) -> dict:
    """A result in the engine's form; raises if it is none."""
    out = {"status": "skip"} if out is None else dict(out)
    if out.get("status") not in STATUSES:
        raise ValueError(f"status {out.get('status')!r} is none of {', '.join(STATUSES)}")
    if out.get("security_risk", "NONE") not in RISKS:
        raise ValueError(f"security risk {out['security_risk']!r} is none of {', '.join(RISKS)}")
    bad = out["status"] in ("fail", "warn")
    if bad and not out.get("failure_type"):
        raise ValueError(f"a result of status {out['status']} needs a failure type")
    return {
        "analyzer": analyzer.name, "at": at, "weight": analyzer.weight, "status": out["status"], "failure_type": out.get("failure_type") if bad else None, "stage": out.get("stage", analyzer.stage),
        "score": None if out.get("score") is None else float(out["score"]), "security_risk": out.get("security_risk", "NONE"), "evidence": [str(e) for e in out.get("evidence", ())], "marks": [str(m) for m in out.get("marks", ())],
    }


def one(analyzer: Analyzer, at: int, run: dict) -> dict:
    """The analyzer's result on a run, or what stands for its failure."""
    try:
        return checked(analyzer, at, analyzer.run(run))
    except Exception as e:  # an extension must not end the job
        base = {"analyzer": analyzer.name, "at": at, "weight": analyzer.weight, "stage": "UNKNOWN" if analyzer.critical else analyzer.stage, "score": None, "security_risk": "NONE", "evidence": [f"{type(e).__name__}: {e}"]}
        return base | ({"status": "fail", "failure_type": "INCOMPLETE_DIAGNOSIS", "marks": ["analyzer_error"]} if analyzer.critical else {"status": "skip", "failure_type": None, "marks": ["analyzer_error"]})


def isolated(analyzers: Iterable[Analyzer], columns: Iterable[str], first: int = 100) -> Column:
    """All analyzers' results on a row: an array of ``RESULT``, in order of the analyzers, numbered from ``first``."""
    own = tuple(analyzers)
    names = [c for c in FIELDS if c in set(columns)]
    if len({a.name for a in own}) < len(own):
        raise ValueError("two analyzers have one name")

    @F.pandas_udf(f"array<{RESULT}>")
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([[one(a, first + i, r) for i, a in enumerate(own)] for r in rows.to_dict("records")], dtype=object)

    return run(F.struct(*names))


#: Analyzers without which a run is not clean, and when they are needed: (name, condition).
REQUIRED: tuple[tuple[str, Callable[[], Column]], ...] = (
    ("parser", lambda: F.lit(True)),
    ("retrieval", lambda: F.lit(True)),
    ("grounding", lambda: F.size("claims") > 0),
    ("citation_faithfulness", lambda: (F.size("claims") > 0) & (F.size("cited") > 0)),
    ("validity", lambda: F.size("cited") > 0),
)


def missing(results: Column, required: Iterable[tuple[str, Callable[[], Column]]]) -> Column:
    """Names of needed analyzers that did not complete: without a result, skipped, or failed by an error of their own."""
    done = F.transform(F.filter(results, lambda r: (r["status"] != "skip") & ~F.array_contains(r["marks"], "analyzer_error")), lambda r: r["analyzer"])
    each = [F.when(F.coalesce(when(), F.lit(False)) & ~F.array_contains(done, name), F.lit(name)) for name, when in required]
    return F.array_compact(F.array(*each)).cast("array<string>") if each else F.array().cast("array<string>")


# ---- validators and chunkers -------------------------------------------------------------------------------------

FINDINGS = "validator string, doc_id string, chunk string, check string, severity string"


def validated(chunks: DataFrame, validators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The findings of all validators, each a function of the chunks to a table of (doc_id, chunk, check, severity) at least.

    A validator whose plan cannot be built, or whose columns are others, gives one row with the check ``validator_error``. Its expressions must be total, as they run with the job.
    """
    out = chunks.sparkSession.createDataFrame([], FINDINGS)
    for name, validate in validators.items():
        try:
            found = validate(chunks).select(F.lit(name).alias("validator"), F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk").cast("string").alias("chunk"), "check", "severity")
        except Exception as e:
            found = chunks.sparkSession.createDataFrame([(name, None, None, "validator_error", f"{type(e).__name__}")], FINDINGS)
        out = out.unionByName(found)
    return out


def chunked(docs: DataFrame, chunkers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The chunks of all chunkers, each a function of the documents to a table of (doc_id, chunk, text): ``strategy`` is the chunker's name."""
    out = None
    for name, chunk in chunkers.items():
        own = chunk(docs).select(F.lit(name).alias("strategy"), "doc_id", F.col("chunk").cast("string").alias("chunk"), "text")
        out = own if out is None else out.unionByName(own)
    return out
