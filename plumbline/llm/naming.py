"""Exact duplicates by deterministic naming of blocks (columns and SQL functions only).

Every normalised text is cut into blocks of ``BLOCK`` bytes. Equal blocks are sorted together and get one
integer name; then each two neighbouring names of a document are named as a pair, level by level, until a
document has one name. Two texts are equal if and only if they end at the same level with the same name: names stand
for contents and not for hashes, so nothing can collide.

One naming step (``named``) shuffles its rows once, by what is to be named, sorts each partition and numbers
the groups by the place of their first row. Keys with more than ``max(FEW, rows / MOST_HOT)`` rows are
counted out first, by hash; there are ``MOST_HOT`` of them at most, they are named in a table of their own that is
broadcast, and their rows are dealt out by document and not by key.
Names depend on a partition's rows alone, not on their order, so a task that runs again names alike.

Defined results: null text counts as empty; an empty text is one empty block; texts of any length are
read whole; a null id is smaller than any other, and where all ids of a group are null, ``keep_id`` is null and one row is
kept; of rows alike in id and text exactly one is kept if their id is the largest; an empty table gives an empty
result; other columns of the input take no part, whatever they are called.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import pieces, stored

BLOCK = 512
FEW = 256
MOST_HOT = 100_000
PART_BYTES = 32 << 20
PART_ROWS = 500_000
ROW = ("doc_id", "digest")


def normalised(text: Column) -> Column:
    """The text with A to Z, and no other letter, in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def blocks_of(data: Column, size: int) -> Column:
    """Blocks of ``size`` bytes of a binary column, one empty block of nothing. ``data`` is bound once, as it would else be made anew for each block."""
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(b) - 1, F.lit(0)) / F.lit(size)).cast("int")), lambda i: F.substring(b, i * size + 1, F.lit(size)))
    return F.transform(F.array(data), cut)[0]


def named(rows: DataFrame, keys: list[str], n: int, parts: int, few: int) -> DataFrame:
    """``rows`` with ``name``, a long that is the same for rows with equal ``keys`` (null equals null) and differs for others; ``keys`` go."""
    spark, rest = rows.sparkSession, [c for c in rows.columns if c not in keys]
    probe = F.xxhash64(*keys)
    counts = rows.groupBy(probe.alias("__probe")).agg(F.count(F.lit(1)).alias("__n"))
    hot = stored(counts.where(F.col("__n") > max(few, n // MOST_HOT)).select("__probe"), "naming-hot")
    if hot.isEmpty():
        flagged = rows.select("*", F.lit(None).cast("long").alias("__hot"))
    else:
        # at most MOST_HOT hashes, so at most as many keys, but for collisions; each has a block or a pair of names
        found = rows.withColumn("__probe", probe).join(F.broadcast(hot), "__probe", "left_semi").select(*keys).distinct()
        order = F.row_number().over(Window.orderBy(*keys))
        known = stored(found.select(*(F.col(k).alias(f"__{k}") for k in keys), (-order).cast("long").alias("__hot")), "naming-known")
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        flagged = rows.join(F.broadcast(known), same, "left").drop(*(f"__{k}" for k in keys))
    # rows of hot keys carry neither the key nor its fate: they are dealt out by document
    spread = flagged.select(
        *rest, "__hot", *(F.when(F.col("__hot").isNull(), F.col(k)).alias(k) for k in keys), F.when(F.col("__hot").isNotNull(), F.xxhash64(*ROW, "pos")).alias("__salt")
    )
    by = [*keys, "__salt"]
    placed = spread.repartition(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    first = F.min("__at").over(Window.partitionBy(*by))
    return placed.select(*rest, F.coalesce("__hot", first).alias("name"))


def paired(names: DataFrame) -> DataFrame:
    """Neighbouring names of a document side by side; ``width`` is the number of names it had. Rows alike fall together and are counted in ``copies``."""
    even = F.col("pos") % 2 == 0
    return names.groupBy(*ROW, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"), F.max("width").alias("width"), F.sum(F.when(even, F.col("copies"))).alias("copies")
    )


def identities(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row for each id and text: ``doc_id``, ``digest`` (sha256 of the normalised text), ``copies`` and its identity ``level`` and ``name``."""
    low = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("low"))
    data = F.col("low").cast("binary")
    cut = low.select("doc_id", F.unhex(F.sha2(data, 256)).alias("digest"), blocks_of(data, block).alias("blocks"))
    rows = cut.select("doc_id", "digest", F.size("blocks").alias("width"), F.lit(1).cast("long").alias("copies"), F.posexplode("blocks").alias("pos", "block"))
    size = F.greatest(F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / F.lit(block)), F.lit(1))
    n, widest = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(1))).first()
    names = named(rows, ["block"], int(n), pieces(docs, text, PART_BYTES, 8), few)
    done, n, levels = [], int(n), math.ceil(math.log2(max(int(widest), 1)))
    for level in range(levels + 1):
        state = stored(paired(names), f"naming-{level}")
        done.append(state.where("width = 1").select(*ROW, "copies", F.lit(level).alias("level"), F.col("a").alias("name")))
        n = n // 2 + 1
        left = state.where("width > 1").withColumn("width", F.ceil(F.col("width") / 2).cast("int"))
        names = named(left, ["a", "b"], n, max(8, math.ceil(n / PART_ROWS)), few) if level < levels else None
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return stored(out, "naming-identities")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, few: int = FEW) -> DataFrame:
    """One row for each document: ``doc_id``, ``keep_id`` (the largest id of its group), ``group_size``, ``kept``, ``text_sha256``."""
    own = identities(docs, doc_id=doc_id, text=text, block=block, few=few)
    groups = stored(own.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "naming-groups")
    limit = max(few, own.count() // MOST_HOT)
    # groups over the limit: MOST_HOT at most, unless rows repeat by the thousand
    large = F.broadcast(groups.where(F.col("group_size") > limit)) if groups.where(F.col("group_size") > limit).count() <= MOST_HOT else groups.where(F.col("group_size") > limit)
    small = own.join(large.select("level", "name"), ["level", "name"], "left_anti").join(groups.where(F.col("group_size") <= limit), ["level", "name"])
    rows = own.join(large, ["level", "name"]).unionByName(small)
    each = rows.select("*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY doc_id DESC NULLS LAST) AS place, max(doc_id) OVER (PARTITION BY low) AS keep_id, count(*) OVER (PARTITION BY low) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(low) AS text_sha256 FROM r
"""
