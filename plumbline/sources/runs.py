"""Runs as nested rows: schema, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "struct<chunk_id:string,text:string,source_doc_id:string,score:double,metadata:map<string,string>>"
ENTRY = "struct<doc_id:string,text:string,timestamp:timestamp,metadata:map<string,string>>"
RUN = f"run_id string, query string, retrieved_chunks array<{CHUNK}>, final_answer string, cited_doc_ids array<string>, answer_confidence double, corpus_entries array<{ENTRY}>, metadata map<string,string>, created_at timestamp"


def read_runs(spark: SparkSession, path: str, *, multiline: bool = True) -> DataFrame:
    """Runs from JSON files; a file that is no run fails the read."""
    return spark.read.schema(RUN).option("mode", "FAILFAST").json(path, multiLine=multiline)


def read_cases(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines) of a JSON-lines file."""
    rows = spark.read.schema(T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path).cache()
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def renamed(rows: DataFrame, text: str, doc: str, score: str | None = None) -> DataFrame:
    """Rows of another framework as chunks."""
    return rows.select(F.col(text).alias("text"), F.col(doc).cast("string").alias("source_doc_id"), (F.col(score) if score else F.lit(None)).cast("double").alias("score"))


def metadata_value(metadata, *keys: str):
    """The first value there is under any of the keys, in any case."""
    low = F.transform_keys(metadata, lambda k, v: F.lower(k))
    return F.coalesce(*(F.element_at(low, F.lit(k.lower())) for k in keys))


def write_diagnoses(diagnoses: DataFrame, path: str) -> None:
    diagnoses.write.mode("append").json(path)


def audit_entries(diagnoses: DataFrame) -> DataFrame:
    """The summary that the audit log keeps of each diagnosis."""
    return diagnoses.select("run_id", "created_at", "primary_failure", "stage", "security_risk", "confidence", "should_have_answered", "human_review")


def audit_tail(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n).orderBy("created_at", "run_id")
