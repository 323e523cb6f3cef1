"""Metrics over gold and predicted labels; every one is a single pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def classification(rows: DataFrame, *, gold="gold", pred="pred", by: list[str] | None = None) -> DataFrame:
    """Counts and accuracy, precision, recall and F1 of label 1."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    out = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), _n(g & p).alias("tp"), _n(~g & p).alias("fp"), _n(g & ~p).alias("fn"), _n(~g & ~p).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    return out.withColumns({"accuracy": d(tp + tn, n), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def confusion(rows: DataFrame, *, gold="gold", pred="pred") -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))


def reliability(rows: DataFrame, *, keys: list[str], y="y") -> DataFrame:
    """Mean outcome for each combination of keys and for the last key alone, by grouping sets."""
    last = keys[-1]
    out = rows.groupingSets([[F.col(k) for k in keys], [F.col(last)]], *(F.col(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))
    name = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("default")) for k in keys))
    return out.select(name.alias("cell"), "n", "mean")


def brier_ece(rows: DataFrame, *, p="p", y="y", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over bins (lo, hi]; p = 0 is in no bin."""
    binned = rows.withColumn("bin", F.ceil(F.col(p) * bins))
    one = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))
    inside = F.col("bin") >= 1
    total = F.sum("c")
    return one.agg((F.sum("sq") / total).alias("brier"), (F.sum(F.when(inside, F.abs(F.col("sp") - F.col("sy"))).otherwise(0.0)) / total).alias("ece"))


def sweep(rows: DataFrame, thresholds: list[float], *, score="score", gold="gold") -> DataFrame:
    """Confusion counts and F1 at each threshold. The thresholds are a fixed small list: rows fan out by it in one explode, before a partial aggregate."""
    out = rows.select(score, gold, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))
    return classification(out, gold=gold, pred="pred", by=["threshold"])


def ppi(rows: DataFrame, *, automated="automated", gold="gold", z: float = 1.96) -> DataFrame:
    """Prediction-powered mean with its interval, clamped to [0, 1]; rows without gold count for the automated mean alone."""
    diff = F.when(F.col(gold).isNotNull(), F.col(gold) - F.col(automated))
    a = rows.agg(F.avg(automated).alias("ma"), F.var_samp(automated).alias("va"), F.count(automated).alias("na"), F.avg(diff).alias("md"), F.var_samp(diff).alias("vd"), F.count(diff).alias("nd"))
    mean = F.col("ma") + F.col("md")
    half = F.sqrt(F.col("va") / F.col("na") + F.col("vd") / F.col("nd")) * z
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    status = F.when(F.col("nd") < 30, "insufficient").when(F.col("nd") < 150, "provisional").otherwise("calibrated")
    return a.select(clamp(mean).alias("mean"), clamp(mean - half).alias("low"), clamp(mean + half).alias("high"), F.col("nd").alias("n_gold"), status.alias("status"))


def majority(votes: DataFrame, *, item: str, label: str) -> DataFrame:
    """The most frequent label of each item, ties to the first by name, and its share."""
    c = votes.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(item)
    c = c.withColumn("share", F.col("c") / F.sum("c").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("c"), label)))
    return c.where("rn = 1").select(item, F.col(label).alias("winner"), F.col("c").alias("votes"), "share")


def expectations(gold: DataFrame, found: DataFrame, *, key: str) -> DataFrame:
    """Each case's expected and found failure, whether type or stage match, and whether expected secondary failures are among the found ones."""
    both = gold.join(found, key)
    return both.withColumns(
        {
            "type_match": F.col("expected_failure").eqNullSafe(F.col("found_failure")),
            "stage_match": F.col("expected_stage").eqNullSafe(F.col("found_stage")),
            "secondary_match": F.size(F.array_except("expected_secondary", "found_secondary")) == 0,
        }
    )


def calibrated(claims: DataFrame, cells: DataFrame, *, keys: list[str], score: str = "score") -> DataFrame:
    """Each claim's confidence from a reliability table (``cell``, ``mean``): its own cell, else the one of its last key alone, else null. The table is an aggregate over few keys."""
    text = lambda k: F.col(k).cast("string")
    own = F.concat_ws(":", *(F.coalesce(text(k), F.lit("default")) for k in keys))
    rows = claims.withColumns({"__own": own, "__rest": F.concat_ws(":", *(F.lit("default") for _ in keys[:-1]), text(keys[-1]))})
    for name in ("__own", "__rest"):
        rows = rows.join(cells.select(F.col("cell").alias(name), F.col("mean").alias(f"{name}_mean")), name, "left")
    return rows.withColumn("calibrated", F.coalesce("__own_mean", "__rest_mean")).drop("__own", "__rest", "__own_mean", "__rest_mean")


def analyzer_audit(results: DataFrame, cases: DataFrame, *, case: str = "case_id") -> DataFrame:
    """How each analyzer fares: candidates, selections, right and wrong ones, right types and stages, false CLEANs, and cases it alone named but lost.

    ``results``: case, analyzer, failure_type, stage, selected. ``cases``: case, expected_type, expected_stage, actual_type, actual_stage.
    """
    rows = results.join(cases, case)
    type_, stage = F.col("failure_type").eqNullSafe(F.col("expected_type")), F.col("stage").eqNullSafe(F.col("expected_stage"))
    passed = F.col("actual_type").eqNullSafe(F.col("expected_type")) & F.col("actual_stage").eqNullSafe(F.col("expected_stage"))
    selected, named = F.col("selected"), F.col("failure_type").isNotNull()
    clean = selected & (F.col("failure_type") == "CLEAN") & (F.col("expected_type") != "CLEAN")
    return rows.groupBy("analyzer").agg(
        _n(named).alias("candidates"), _n(selected).alias("selected"), _n(selected & type_ & stage).alias("tp"), _n(selected & ~(type_ & stage)).alias("fp"), _n(~passed & named & type_ & stage & ~selected).alias("fn"),
        _n(selected & type_).alias("type_right"), _n(selected & stage).alias("stage_right"), _n(F.coalesce(clean, F.lit(False))).alias("false_clean"),
    )


def audit_totals(cases: DataFrame, *, by: list[str]) -> DataFrame:
    """Cases and passes for each mode, each category and in all, by rollup-like grouping sets; null stands for all."""
    passed = F.col("actual_type").eqNullSafe(F.col("expected_type")) & F.col("actual_stage").eqNullSafe(F.col("expected_stage"))
    out = cases.withColumn("__ok", passed.cast("long")).groupingSets([[F.col(b)] for b in by] + [[]], *(F.col(b) for b in by))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("__ok").alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))


def heldout(rows: DataFrame, names: dict[str, str], *, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Exact accuracy, detection and false alarms of predictions under common names; a name that is not mapped is OTHER."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    own = rows.select(F.col(gold).alias("g"), F.coalesce(F.element_at(table, F.col(pred)), F.lit("OTHER")).alias("p"))
    clean = F.col("g") == "CLEAN"
    out = own.agg(F.count(F.lit(1)).alias("n"), _n(F.col("g") == F.col("p")).alias("correct"), _n(clean).alias("clean"), _n(clean & (F.col("p") != "CLEAN")).alias("false_alarms"), _n(~clean & (F.col("p") != "CLEAN")).alias("detected"))
    return out.withColumns({"accuracy": F.try_divide(F.col("correct").cast("double"), F.col("n")), "detection": F.try_divide(F.col("detected").cast("double"), F.col("n") - F.col("clean"))})


def best_setting(swept: DataFrame, *, setting: str = "threshold", false_pass: str = "fp", f1: str = "f1") -> DataFrame:
    """The setting with fewest false passes, then the highest F1, then the least setting (a top-1 report over a fixed grid)."""
    return swept.orderBy(F.asc(false_pass), F.desc_nulls_last(f1), setting).limit(1)
