"""Mixing sources to target weights with exact budgets.

Every row gets a hash-random key. Rows are dealt into key ranges within their source (about
``ROWS_PER_RANGE`` rows each, so a hot source is spread over many tasks), each range is sorted by
key, and the prefix sum of a row's words is the sum over the earlier ranges plus the running sum in
its own range. A source takes its whole text as often as its target holds it, and then rows in key
order until exactly the words that are left.

Defined results for odd input: null text has size 0 and is never taken; a null source is a source of
its own, last in order; a null id hashes as the empty text; rows that are alike in id and size are
interchangeable; an empty table gives an empty result; other columns pass through, and internal names
start with ``__mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD

ROWS_PER_RANGE = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """60 bits of the md5 of seed and id: the same in every run and on every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: its words, rows and target. The windows run over one row for each source.

    A target is ``min(most * size, level * weight)`` with the level at which targets sum to ``share``
    of all words. Sources are met in order of ``most * size / weight``; one is full if the level so
    far reaches it.
    """
    one = (
        sized.groupBy(F.col("__mix_source"))
        .agg(F.sum("__mix_size").alias("__mix_total"), F.count(F.lit(1)).alias("__mix_rows"))
        .withColumn("__mix_id", F.row_number().over(Window.orderBy(F.col("__mix_source").asc_nulls_last())))
    )
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("__mix_id") - 1) % len(weights) + 1).cast("int"))
    one = one.withColumn("__mix_weight", weight).withColumn("__mix_cap", F.col("__mix_total") * F.lit(most))
    all_ = Window.partitionBy(F.lit(0))
    met = Window.partitionBy(F.lit(0)).orderBy(F.col("__mix_cap") / F.col("__mix_weight"), "__mix_id").rowsBetween(Window.unboundedPreceding, -1)
    one = one.select(
        "*",
        (F.sum("__mix_total").over(all_) * F.lit(share)).alias("__mix_want"),
        F.sum("__mix_weight").over(all_).alias("__mix_weights"),
        F.coalesce(F.sum("__mix_cap").over(met), F.lit(0.0)).alias("__mix_caps"),
        F.coalesce(F.sum("__mix_weight").over(met), F.lit(0.0)).alias("__mix_met"),
    )
    level = (F.col("__mix_want") - F.col("__mix_caps")) / (F.col("__mix_weights") - F.col("__mix_met"))
    one = one.withColumn("__mix_full", level >= F.col("__mix_cap") / F.col("__mix_weight"))
    full = lambda x: F.sum(F.when(F.col("__mix_full"), F.col(x)).otherwise(F.lit(0.0))).over(all_)
    rest = F.try_divide(F.col("__mix_want") - full("__mix_cap"), F.col("__mix_weights") - full("__mix_weight"))
    return one.withColumn("target", F.when(F.col("__mix_full"), F.col("__mix_cap")).otherwise(F.col("__mix_weight") * rest)).select(
        "__mix_source", "__mix_id", F.col("__mix_total").alias("source_size"), "__mix_rows", "target"
    )


def mix(
    docs: DataFrame, size: Column, *, doc_id: str = "doc_id", source: str = "source", seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words taken, repeats counted)."""
    docs = docs.drop("size", "source_size", "target", "taken")
    sized = docs.select("*", F.col(source).alias("__mix_source"), F.greatest(size, F.lit(0)).cast("long").alias("__mix_size"))
    by = targets(sized.select("__mix_source", "__mix_size"), weights, share, most)
    keyed = sized.withColumn("__mix_key", random_key(F.col(doc_id), seed))
    keyed = keyed.join(by.withColumnRenamed("__mix_source", "__mix_of"), F.col("__mix_source").eqNullSafe(F.col("__mix_of"))).drop("__mix_of")
    ranges = F.ceil(F.col("__mix_rows") / F.lit(rows_per_range))
    keyed = keyed.withColumn("__mix_range", F.floor(F.col("__mix_key") / (F.lit(float(1 << 60)) / ranges)).cast("long"))
    sums = keyed.groupBy("__mix_id", "__mix_range").agg(F.sum("__mix_size").alias("__mix_sum"))
    ahead = Window.partitionBy("__mix_id").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("__mix_id").alias("__mix_i"), F.col("__mix_range").alias("__mix_r"), F.coalesce(F.sum("__mix_sum").over(ahead), F.lit(0)).alias("__mix_start"))
    inside = Window.partitionBy("__mix_id", "__mix_range").orderBy("__mix_key", doc_id, "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__mix_before", F.coalesce(F.sum("__mix_size").over(inside), F.lit(0)))
    placed = placed.join(starts, (F.col("__mix_id") == F.col("__mix_i")) & (F.col("__mix_range") == F.col("__mix_r")))
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target)") .cast("long") - F.pmod(words, F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    times = F.when(F.col("source_size") > 0, (whole / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    left = words - whole - F.col("__mix_start") - F.col("__mix_before")
    taken = times * F.col("__mix_size") + F.greatest(F.lit(0), F.least(F.col("__mix_size"), left))
    out = placed.withColumn("taken", taken.cast("long")).withColumn("size", F.col("__mix_size"))
    return out.select(*docs.columns, "size", "source_size", "target", "taken")


def cuts(mixed: DataFrame, *, doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row a source: how often the mix takes it whole, and the last row in key order that gets more, with what rows alike get on average.

    Rows alike in id and size that stand at a source's cut share its words equally, to the next lower whole number.
    """
    times = F.expr("floor(target)").cast("long") - F.pmod(F.floor("target").cast("long"), F.greatest("source_size", F.lit(1)))
    times = F.when(F.col("source_size") > 0, (times / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rows = mixed.select(F.col(source).alias("__cut_of"), F.struct(random_key(F.col(doc_id), seed).alias("k"), F.col(doc_id).alias("d"), F.col("size").alias("s")).alias("at"), times.alias("times"), (F.col("taken") - times * F.col("size")).alias("more"))
    alike = rows.groupBy("__cut_of", "at", "times").agg(F.sum("more").alias("more"), F.count(F.lit(1)).alias("n"))
    last = F.max(F.when(F.col("more") > 0, F.struct("at", F.floor(F.col("more") / F.col("n")).cast("long").alias("each"))))
    return alike.groupBy("__cut_of").agg(F.max("times").alias("__cut_times"), last.alias("__cut"))


def applied(docs: DataFrame, size: Column, cut: DataFrame, *, doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """``docs`` with ``size`` and ``taken`` by the cuts of their sources. Rows stay where they are: the cuts are one row a source, small wherever sources are few, and their stored size tells the planner so."""
    rows = docs.withColumn("size", F.greatest(size, F.lit(0)).cast("long"))
    rows = rows.join(cut, F.col(source).eqNullSafe(F.col("__cut_of")), "left")
    own, at = F.struct(random_key(F.col(doc_id), seed).alias("k"), F.col(doc_id).alias("d"), F.col("size").alias("s")), F.col("__cut")["at"]
    more = F.when(F.col("__cut").isNull(), 0).when(own < at, F.col("size")).when(own == at, F.col("__cut")["each"]).otherwise(0)
    return rows.withColumn("taken", (F.col("__cut_times") * F.col("size") + more).cast("long")).drop("__cut_of", "__cut_times", "__cut")


def materialised(mixed: DataFrame, columns: list[str], *, text: str = "text") -> DataFrame:
    """The mix as rows: a document once for each whole time it is taken, and the document at a source's cut, if the cut is inside it, up to its last word taken."""
    times = F.expr("array_repeat(size, int(taken div greatest(size, 1)))")
    rest = F.expr("CASE WHEN size > 0 AND taken % size > 0 THEN array(taken % size) ELSE array() END")
    rows = mixed.where("taken > 0").withColumn("__mix_words", F.explode(F.concat(times, rest)))
    ends = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    part = F.array_join(F.slice(ends, F.lit(1), F.col("__mix_words").cast("int")), "")
    return rows.select(*(F.when(F.col("__mix_words") < F.col("size"), part).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source),
m AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS want, sum(w) OVER () AS ws,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS caps,
         coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS met
  FROM s),
f AS (SELECT *, (want - caps) / (ws - met) >= cap / w AS filled FROM m),
t AS (
  SELECT source, source_size,
         CASE WHEN filled THEN cap ELSE w * ((want - sum(CASE WHEN filled THEN cap ELSE 0.0 END) OVER ()) / nullif(ws - sum(CASE WHEN filled THEN w ELSE 0.0 END) OVER (), 0.0)) END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (CAST(floor(target) AS BIGINT) // source_size) * size
         + greatest(0, least(size, CAST(floor(target) AS BIGINT) % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
