"""Chunkers and fault-injecting transforms of chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import stored


def fixed_windows(docs: DataFrame, *, doc="doc_id", text="text", size: int = 200, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words that overlap; the last one stops at the end."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    n = F.size("words")
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    out = docs.select(doc, words.alias("words")).where("size(words) > 0").withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    return out.select(doc, "window", F.array_join(F.slice("words", F.col("window") * step + 1, F.lit(size)), " ").alias("chunk"), F.least(n - F.col("window") * step, F.lit(size)).alias("n_words"))


def oversegment(chunks: DataFrame, *, text="text", longest: int = 100) -> DataFrame:
    """Chunks over ``longest`` characters are cut in the middle."""
    half = F.floor(F.length(text) / 2).cast("int")
    parts = F.when(F.length(text) > longest, F.array(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))).otherwise(F.array(text))
    rest = [c for c in chunks.columns if c != text]
    return chunks.select(*rest, F.posexplode(parts).alias("part", text))


def undersegment(chunks: DataFrame, *, group: str, order: str, text="text", pair: int = 2) -> DataFrame:
    """Neighbouring chunks of a group are merged in pairs."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    out = chunks.withColumn("merged", F.floor(rn / pair)).groupBy(group, "merged").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("x"))
    return out.select(group, "merged", F.array_join(F.transform("x", lambda s: s[text]), "\n").alias(text), F.size("x").alias("n"))


def duplicate(chunks: DataFrame, times: int = 3) -> DataFrame:
    return chunks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def erase_markers(chunks: DataFrame, *, text="text") -> DataFrame:
    """Numbers of list items and headings' signs at the beginning of lines go."""
    return chunks.withColumn(text, F.regexp_replace(text, r"(?m)^[ \t]*(?:\d+[.)]|[#*\-]+)[ \t]+", ""))


def ancestors(nodes: DataFrame, *, node="node_id", parent="parent_id") -> DataFrame:
    """(node, ancestor, depth) of every node and all above it, itself at depth 0, by pointer doubling.

    Round k knows all ancestors nearer than 2**k and each node's one at just 2**k; it joins both, so a chain of a thousand nodes takes ten
    rounds. Rounds are stored. Parents that are no nodes count as none. Nodes on or below a cycle
    have no root: they are left out (``cyclic`` lists them).
    """
    links = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL")
    known = links.select(F.col("node").alias("up"))
    jump = stored(links.where("up IS NOT NULL").join(known.distinct(), "up", "left_semi").select("node", "up"), "jump")
    bound = links.count()
    found = links.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("depth")).distinct()
    step = 1
    while not jump.isEmpty():
        if step > bound:  # only a cycle is longer than the number of nodes
            looped = jump.select("node").distinct()
            return found.join(looped, "node", "left_anti")
        above = jump.select(F.col("node").alias("ancestor"), F.col("up").alias("next"))
        found = stored(found.unionByName(found.join(above, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + step).alias("depth"))), "ancestors")
        jump = stored(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")), "jump")
        step *= 2
    return found


def cyclic(nodes: DataFrame, *, node="node_id", parent="parent_id") -> DataFrame:
    """Nodes on a cycle of parent links, or below one: those that still have an ancestor as many links up as there are nodes."""
    jump = stored(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL AND up IS NOT NULL"), "cyclic")
    bound, step = nodes.count(), 1
    while step <= bound and not jump.isEmpty():
        jump = stored(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")).distinct(), "cyclic")
        step *= 2
    return jump.select(F.col("node").alias(node)).distinct()


def descendants(nodes: DataFrame, *, node="node_id", parent="parent_id") -> DataFrame:
    """(ancestor, node, depth) of a forest: every node with all below it, itself at depth 0."""
    return ancestors(nodes, node=node, parent=parent).select("ancestor", "node", F.col("depth").cast("int").alias("depth"))


def boundary_damage(chunks: DataFrame, *, run: str, rank: str, doc: str, text="text") -> DataFrame:
    """Chunks that end without a stop where the same document's next chunk begins in lower case."""
    w = Window.partitionBy(run).orderBy(rank)
    out = chunks.withColumn("next_text", F.lead(text).over(w)).withColumn("next_doc", F.lead(doc).over(w))
    return out.where((F.col(doc) == F.col("next_doc")) & ~F.rtrim(text).rlike(r"[.!?:;]\s*$") & F.col("next_text").rlike(r"^\s*[a-z]")).drop("next_text", "next_doc")


def hierarchical(nodes: DataFrame, *, node="node_id", parent="parent_id", text="text", order="pos") -> DataFrame:
    """One chunk a node: its text and that of all nodes below it, in document order."""
    below = descendants(nodes, node=node, parent=parent)
    own = nodes.select(F.col(node).alias("node"), F.col(order).alias("o"), F.col(text).alias("t"))
    out = below.join(own, "node").groupBy("ancestor").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("x"))
    return out.select(F.col("ancestor").alias(node), F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("chunk"), F.size("x").alias("n_nodes"))


def retrieved(queries: DataFrame, index: DataFrame, *, query: str, key: str, k: int = 5) -> DataFrame:
    """The ``k`` chunks of each query that share most terms with it, found by their terms and not by all pairs; ties by key."""
    from plumbline.functions import text as X

    q = queries.select(query, F.explode(X.terms("text")).alias("t"))
    c = index.select(key, F.explode(X.terms("text")).alias("t"))
    hits = q.join(c, "t").groupBy(query, key).agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dry_answer(top: DataFrame, *, score: str = "score") -> DataFrame:
    """A confidence for an answer made of the best chunk alone: (score + 1) / 2 between .25 and .99."""
    c = F.round(F.least(F.greatest((F.col(score) + 1) / 2, F.lit(0.25)), F.lit(0.99)), 2)
    return top.withColumn("confidence", c)
