"""Diagnosis of a stream of runs, and windowed counts over its log.

A diagnosis needs one row only, so the batch expressions run on a stream unchanged and without state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.diagnose import diagnose
from plumbline.sources.runs import RUN, audit_entries


def diagnose_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, *, as_of: str, available_now: bool = True) -> StreamingQuery:
    """JSON-lines runs from a folder to audit entries in another; a restart goes on from the checkpoint."""
    runs = spark.readStream.schema(RUN).json(source)
    writer = audit_entries(diagnose(runs, as_of=as_of)).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(sink)


def failure_counts(entries: DataFrame, *, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failures for each window of event time; works on streams and tables."""
    rows = entries.withWatermark("created_at", late) if entries.isStreaming else entries
    return rows.groupBy(F.window("created_at", every), "primary_failure").agg(F.count(F.lit(1)).alias("n"))
