"""The driver's tables and the views over them that stand for runs, chunks, citations and gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = "2001-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as retrieved chunks: run, rank, score in [0, 1], document and a failure type."""
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return rows.select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(w).alias("rank"), (F.col("l_discount") * 10).alias("score"),
        F.col("l_partkey").alias("doc_id"), F.col("l_returnflag").alias("failure_type"), F.col("l_shipdate").cast("date").alias("date"),
    )


SCORE_RUNS_SQL = """score_runs AS (
  SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS rank,
         l_discount * 10 AS score, l_partkey AS doc_id, l_returnflag AS failure_type, CAST(l_shipdate AS DATE) AS date
  FROM lineitem)"""


def qa_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's next one: run id, query and answer."""
    turns = table(spark, sf_dir, "conversations")
    ask = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    say = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return ask.join(say, ["conv_id", "turn"])


QA_RUNS_SQL = """qa_runs AS (
  SELECT q.conv_id, q.turn, q.text AS query, a.text AS answer
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a heuristic prediction and a probability from the length."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return rows.select("doc_id", "lang", "quality", "toxic", F.col("quality").alias("gold"), (F.col("n_chars") >= 500).cast("int").alias("pred"), p.alias("p"))


GOLD_SQL = """gold AS (
  SELECT l.doc_id, d.lang, l.quality, l.toxic, l.quality AS gold, CAST(d.n_chars >= 500 AS INTEGER) AS pred, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
