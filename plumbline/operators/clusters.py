"""Clusters of a run's sampled answers by similarity of stemmed terms, and their entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as W


def clusters(samples: DataFrame, *, run: str, at: str, text: str, least: float = 0.5) -> DataFrame:
    """(run, at, cluster): the transitive closure of Jaccard >= ``least`` within each run; the cluster is its first place.

    A run has few samples, so they are one array and labels are folded over its pairs in place: no shuffle beyond the grouping.
    """
    one = samples.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), W.stemmed_terms(text).alias("t")))).alias("x"))
    n = F.size("x")
    start = F.sequence(F.lit(0), n - 1)
    close = lambda i, j: W.jaccard(F.get("x", i)["t"], F.get("x", j)["t"]) >= least

    def meet(labels, i):
        # Joins the cluster of i with those of all later samples close to it.
        mine = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == i) | ((j > i) & close(i, j)))
        ids = F.transform(mine, lambda j: F.get(labels, j))
        low = F.array_min(ids)
        return F.transform(labels, lambda v: F.when(F.array_contains(ids, v), low).otherwise(v))

    labels = F.aggregate(start, start, meet)
    return one.select(run, F.explode(F.arrays_zip(F.transform("x", lambda s: s["at"]).alias("at"), labels.alias("cluster"))).alias("z")).select(run, F.col("z.at").alias(at), F.col("z.cluster").alias("cluster"))


def entropy(clustered: DataFrame, *, run: str) -> DataFrame:
    """Cluster entropy in bits and the largest cluster's share."""
    from plumbline.operators.scores import label_entropy

    return label_entropy(clustered, run=run, label="cluster")
