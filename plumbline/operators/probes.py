"""Signals of external evaluators: normal labels, bands and the probes they raise, as joins and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N

# Metric -> (failure type, stage, blocking, inverted).
RULES = {
    "faithfulness": ("UNSUPPORTED_CLAIM", "GROUNDING", True, False),
    "groundedness": ("UNSUPPORTED_CLAIM", "GROUNDING", True, False),
    "hallucination": ("UNSUPPORTED_CLAIM", "GROUNDING", True, True),
    "context_precision": ("SCOPE_VIOLATION", "RETRIEVAL", False, False),
    "context_recall": ("INSUFFICIENT_CONTEXT", "RETRIEVAL", True, False),
    "answer_relevancy": ("GENERATION_IGNORE", "GENERATION", False, False),
    "citation_support": ("CITATION_MISMATCH", "GROUNDING", True, False),
    "context_utilization": ("GENERATION_IGNORE", "GENERATION", False, False),
}
LABELS = {"entailment": "entailed", "supported": "entailed", "contradiction": "contradicted", "refuted": "contradicted", "neutral": "unsupported", "not_supported": "unsupported", "unknown": "unsupported"}


def normal_label(label: Column) -> Column:
    """A provider's label in our terms; null for one that is not known."""
    low = F.lower(F.trim(label))
    table = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.when(low.isin("entailed", "contradicted", "unsupported"), low).otherwise(F.element_at(table, low))


def probes(signals: DataFrame, *, cut: float = 0.5) -> DataFrame:
    """One row for each signal (run_id, provider, metric, value) that falls below the cut: what it points at and how gravely. Ids are hashes, so reruns agree."""
    of = lambda i: F.element_at(F.create_map(*(x for k, v in RULES.items() for x in (F.lit(k), F.lit(v[i])))), F.col("metric"))
    value = F.when(of(3), 1 - F.col("value")).otherwise(F.col("value"))
    rows = signals.where(F.col("metric").isin(*RULES)).withColumns({"goodness": value, "band": N.band(value)})
    rows = rows.where(F.col("goodness") < cut)
    return rows.select(
        F.hex(F.xxhash64("run_id", "provider", "metric")).alias("probe_id"), "run_id", "provider", "metric", "band", of(0).alias("failure_type"), of(1).alias("stage"), (of(2) & (F.col("goodness") < cut / 2)).alias("blocking")
    )
