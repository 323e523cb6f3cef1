"""Datasets of cases and metrics over several runs: summaries, rates, generation, calibration and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import taxonomy as X


def support(cases: DataFrame, *, label: str) -> DataFrame:
    """Every failure type with its number of cases and tier, those without any too."""
    names = cases.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{x}'" for x in X.PRIORITY) + ")) AS failure_type")
    n = cases.groupBy(F.col(label).alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))
    out = names.join(n, "failure_type", "left").select("failure_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("tier", F.when(F.col("n") >= 5, "supported").when(F.col("n") >= 1, "thin").otherwise("none"))


def clean_false_positives(rows: DataFrame, *, gold: str, pred: str) -> DataFrame:
    """What clean cases were taken for, and the rate of false alarms."""
    clean = rows.where(F.col(gold) == "CLEAN")
    out = clean.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def over_runs(rows: DataFrame, *, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def duplicates(chunks: DataFrame, *, run: str, order: list[str], text: str) -> DataFrame:
    """Chunks whose normalised text an earlier chunk of the run has."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    w = Window.partitionBy(run, "norm").orderBy(*order)
    return chunks.withColumn("norm", F.xxhash64(norm)).withColumn("rn", F.row_number().over(w)).where("rn > 1").drop("norm", "rn")


def cases(domains: DataFrame, modes: DataFrame) -> DataFrame:
    """One synthetic case for each domain and failure mode; both are small fixed dimensions."""
    return domains.crossJoin(F.broadcast(modes)).withColumn("case_id", F.concat_ws("-", "domain", "mode"))


def triage(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """The first flag of each row, in order, and how many rows each has."""
    first = None
    for name, c in flags.items():
        first = F.when(c, name) if first is None else first.when(c, name)
    return rows.groupBy(first.otherwise("none").alias("root_cause")).agg(F.count(F.lit(1)).alias("n"))


def isotonic(rows: DataFrame, *, p: str = "p", y: str = "y"):
    """A monotone calibration of probabilities, fitted in the JVM; ``transform`` frames that ``with_features`` prepared."""
    return IsotonicRegression(labelCol=y, featuresCol="features").fit(with_features(rows, p=p).select("features", F.col(y).cast("double").alias(y)))


def with_features(rows: DataFrame, *, p: str = "p") -> DataFrame:
    return VectorAssembler(inputCols=[p], outputCol="features").transform(rows)


def embedded(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], *, text: str = "text") -> DataFrame:
    """Each distinct text is embedded once (``embed`` takes and returns a frame keyed by ``text_key``) and joined back by hash."""
    keyed = rows.withColumn("text_key", F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("-")).cast("binary")))
    once = embed(keyed.select("text_key", text).dropDuplicates(["text_key"]))
    return keyed.join(once.drop(text), "text_key", "left").drop("text_key")


def why(results: Column) -> Column:
    """Who voted for what, in the results' order, without repeats."""
    return F.array_distinct(F.transform(F.filter(results, lambda r: r["status"].isin("fail", "warn")), lambda r: F.concat_ws(": ", r["analyzer"], r["failure_type"])))
