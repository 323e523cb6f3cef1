"""Failure types: order, stages, remediation. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITY = (
    "TABLE_STRUCTURE_LOSS", "HIERARCHY_FLATTENING", "METADATA_LOSS", "PROMPT_INJECTION", "SUSPICIOUS_CHUNK", "PRIVACY_VIOLATION",
    "PARSER_STRUCTURE_LOSS", "CHUNKING_BOUNDARY_ERROR", "EMBEDDING_DRIFT", "RETRIEVAL_DEPTH_LIMIT", "RERANKER_FAILURE", "GENERATION_IGNORE",
    "INCOMPLETE_DIAGNOSIS", "CONTRADICTED_CLAIM", "INSUFFICIENT_CONTEXT", "UNSUPPORTED_CLAIM", "CITATION_MISMATCH", "STALE_RETRIEVAL",
    "RETRIEVAL_ANOMALY", "POST_RATIONALIZED_CITATION", "SCOPE_VIOLATION", "INCONSISTENT_CHUNKS", "LOW_CONFIDENCE", "CLEAN",
)
BLOCKING = ("PROMPT_INJECTION", "PRIVACY_VIOLATION", "SUSPICIOUS_CHUNK", "TABLE_STRUCTURE_LOSS", "HIERARCHY_FLATTENING", "METADATA_LOSS", "PARSER_STRUCTURE_LOSS", "CHUNKING_BOUNDARY_ERROR")
HEURISTIC = ("RETRIEVAL_ANOMALY", "SCOPE_VIOLATION", "LOW_CONFIDENCE", "INCONSISTENT_CHUNKS")
SPECIFICITY = {
    "TABLE_STRUCTURE_LOSS": 100, "HIERARCHY_FLATTENING": 100, "METADATA_LOSS": 100, "PARSER_STRUCTURE_LOSS": 100, "CHUNKING_BOUNDARY_ERROR": 100,
    "PROMPT_INJECTION": 95, "PRIVACY_VIOLATION": 95, "CONTRADICTED_CLAIM": 95, "INCOMPLETE_DIAGNOSIS": 90, "POST_RATIONALIZED_CITATION": 82,
    "CITATION_MISMATCH": 80, "UNSUPPORTED_CLAIM": 80, "SUSPICIOUS_CHUNK": 80, "STALE_RETRIEVAL": 75, "INSUFFICIENT_CONTEXT": 88,
    "RETRIEVAL_ANOMALY": 30, "SCOPE_VIOLATION": 20, "LOW_CONFIDENCE": 20,
}
UNANSWERABLE = ("PROMPT_INJECTION", "SUSPICIOUS_CHUNK", "INSUFFICIENT_CONTEXT", "PRIVACY_VIOLATION", "INCOMPLETE_DIAGNOSIS")
STAGES = ("PARSING", "CHUNKING", "EMBEDDING", "RETRIEVAL", "RERANKING", "GROUNDING", "SUFFICIENCY", "GENERATION", "SECURITY", "CONFIDENCE", "UNKNOWN")
RISKS = ("NONE", "LOW", "MEDIUM", "HIGH")


def place(value: Column, order) -> Column:
    """The value's place in a fixed order, after its end if it is not in it."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def tier(failure: Column) -> Column:
    return F.when(failure.isin(*BLOCKING), 0).when(failure.isin(*HEURISTIC), 2).when(failure.isin(*SPECIFICITY), 1).otherwise(3)


def specificity(failure: Column) -> Column:
    out = None
    for name, rank in SPECIFICITY.items():
        out = F.when(failure == name, rank) if out is None else out.when(failure == name, rank)
    return out.otherwise(10)
