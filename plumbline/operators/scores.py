"""Per-run statistics over retrieval scores: one window partition a run, no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _run(run: str) -> Window:
    return Window.partitionBy(run)


def z_outliers(scores: DataFrame, *, run="run_id", score="score", threshold: float = 2.0) -> DataFrame:
    """Adds ``z`` (population deviation) and keeps scores whose z is above the threshold: only high ones; runs of one score or without spread have none."""
    w = _run(run)
    sd = F.stddev_pop(score).over(w)
    out = scores.withColumn("n", F.count(score).over(w)).withColumn("z", F.try_divide(F.col(score) - F.avg(score).over(w), sd))
    return out.where((F.col("n") >= 2) & (F.col("z") > threshold))


def score_cliff(scores: DataFrame, *, run="run_id", score="score", rank="rank", high=0.95, low=0.5, gap=0.45) -> DataFrame:
    """Runs whose best two scores fall from over ``high`` to under ``low`` by more than ``gap``."""
    w = _run(run).orderBy(F.desc(score), rank)
    top = scores.where(F.col(score).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    both = top.groupBy(run).agg(F.max(F.when(F.col("rn") == 1, F.col(score))).alias("first"), F.max(F.when(F.col("rn") == 2, F.col(score))).alias("second"))
    return both.where((F.col("first") > high) & (F.col("second") < low) & (F.col("first") - F.col("second") > gap))


def iqr_outliers(scores: DataFrame, *, run="run_id", score="score", absolute: float = 0.92) -> DataFrame:
    """Scores above Q3 + 1.5 IQR of their run; in runs of fewer than three, above ``absolute``."""
    fence = scores.groupBy(run).agg(F.count(score).alias("n"), F.percentile(score, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    fence = fence.select(run, F.when(F.col("n") < 3, F.lit(absolute)).otherwise(q3 + 1.5 * (q3 - q1)).alias("fence"))
    return scores.join(fence, run).where(F.col(score) > F.col("fence"))


def top_k(rows: DataFrame, *, run="run_id", score="score", rank="rank", k: int = 3) -> DataFrame:
    """The ``k`` best rows of each run, ties by rank."""
    return rows.withColumn("rn", F.row_number().over(_run(run).orderBy(F.desc_nulls_last(score), rank))).where(F.col("rn") <= k)


def best_per(rows: DataFrame, *, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def noise(rows: DataFrame, noisy: Column, *, run="run_id", warn=(0.5, 2), fail=(0.9, 5)) -> DataFrame:
    n, m = F.count(F.lit(1)), F.sum(noisy.cast("long"))
    out = rows.groupBy(run).agg(n.alias("n"), m.alias("noisy"))
    ratio = F.col("noisy") / F.col("n")
    status = F.when((ratio >= fail[0]) & (F.col("n") >= fail[1]), "fail").when((ratio >= warn[0]) & (F.col("n") >= warn[1]), "warn").otherwise("pass")
    return out.withColumn("ratio", ratio).withColumn("status", status)


def label_entropy(rows: DataFrame, *, run="run_id", label="label") -> DataFrame:
    """Shannon entropy in bits of each run's labels and the share of the largest."""
    one = rows.groupBy(run, label).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(_run(run))
    return one.withColumn("p", p).groupBy(run).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.max("p").alias("largest_share"), F.count(F.lit(1)).alias("n_labels"))
