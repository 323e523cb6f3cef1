"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) of every vertex with an edge; the label is the component's least vertex.

    Each step takes the least label among a vertex and its neighbours and then follows labels
    twice, so a chain's length halves or better; only minima are aggregated, so a vertex with many
    edges is no burden. Every step is written to the shared folder, so a lost executor costs one step.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = stored(both.where("u <> v").distinct(), "cc-edges")
    labels = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("m"))
        step = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("v").alias("w"), F.col("label").alias("up"))
        step = step.join(up, step.label == up.w, "left").select("v", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        step = stored(step, "cc-labels")
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            return labels
