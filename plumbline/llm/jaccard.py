"""Similarity join of documents on word shingles by grouped prefixes.

1. One pass over the texts makes each document's set of 64-bit shingle hashes. Blocks of documents
   send packed postings (48 bits of the hash, the document's number) to shards of the hash space; copies
   within a block travel once, and a shingle that many of a block's documents share travels as one count.
   The shards return how many documents have each shingle that occurs more than once.
2. A set's prefix is its n - ceil(0.75 n) + 1 rarest shingles; two sets that link share one of both
   prefixes. Shingles of one document only come first and cannot be shared, so a document with as many
   of them as its prefix holds links with nothing. The others - few - keep their repeated shingles.
3. Documents with equal sets are one class. Classes with one size and one prefix are a group; groups,
   not members, are listed under the prefix's shingles. Each group is first tried with the pivot it shares
   most shingles with (linear in the lists), members are verified and components contracted.
4. Lists of up to ``SMALL`` classes: pairs of different components are filtered by size and by the places of
   the shared shingle, and verified.
5. Longer lists, as of large groups of near copies or passages that many documents hold: every class is
   verified against the list's pivot p, the class with the fewest shingles of its own. If x does not link
   with p, it links with y only if both differ from p in the same shingles, in at least (4 |p - y| + 3 |y - p| + 3 (own
   shingles of y - of p) + 1) / 7 of them. So candidates share one of the first differences of y, those
   that p lacks first. Groups that link among themselves, but not with p, have long lists under these differences too: they
   are contracted with pivots of their own, round by round, before pairs are listed. For random edits hardly any is left.
   Lists of which more is left, as of parts of one text that overlap too little to link, are not listed by pairs either: their classes are dealt to
   blocks and compared in arrays, as in 6.

6. Links are counted in each component, as both ends of every link are in one: its classes are dealt by hash to
   blocks of about ``BLOCK``, and each two blocks are compared in arrays, without a row for each pair. The work grows with
   the square of a component's classes, the rows with that square over ``BLOCK``.

No link between different components is missed; inside a component pairs are counted, not listed.

Two sets link if 100 * |A and B| >= 75 * |A or B|.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own
component; a text with fewer words than a shingle is one shingle; equal texts are one class whatever
their number; a row with a null doc_id keeps its links but is never the least id (a component of such rows
alone has a null id); rows that repeat a doc_id with other texts are separate documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import given_back, pieces, row_key, slices, stored, trimmed
from plumbline.llm.components import components
from plumbline.llm.elias_fano import from_buffer, to_bytes
from plumbline.llm.lm import planes, unplanes

SHINGLE = 5
LEAST, WHOLE = 75, 100  # the constants of long_lists follow from these
STEP = 500_000
KEEP = 200_000
SHARD_BYTES = 6 << 20
#: Documents of a block from which a shingle's postings stay in the block.
HOT = 32
BY_COUNT = np.uint32(2**32 - 1)
#: Classes in a list up to which its pairs are listed.
SMALL = 48
#: Classes in a block whose links are counted or sought.
BLOCK = 512
#: Blocks that crowded lists make at least, if each has so many classes.
BLOCKS, LEAST_BLOCK = 16, 64
ROW = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in "abc")])
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("toks", T.ArrayType(T.LongType()))])


class Shingler:
    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes of a text."""
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(ws) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(ws), seed=1)], np.uint64)
        known = self.words
        if len(known) > KEEP:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        n = len(a) - self.size + 1
        x = a[:n].copy()
        for k in range(1, self.size):
            x *= np.uint64(0x9E3779B97F4A7C15)
            x += a[k : k + n]
            x ^= x >> np.uint64(29)
        return np.unique(x)


def prefix_size(n: int) -> int:
    return n - -(-LEAST * n // WHOLE) + 1


def row(part, block, a, b, c) -> tuple:
    return part, block, a, b, c


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ROW.names)


def postings(shards: int, size: int):
    """The map side: packed postings for the shards and one row that describes the block."""

    def describe(block: int, ids: list, keys: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        first: dict[bytes, int] = {}
        rep = np.array([first.setdefault(s, i) for i, s in enumerate(sigs)], np.uint32)
        own = sorted(set(rep.tolist()))
        tok = np.concatenate([sets[i] for i in own]) >> np.uint64(16)
        idx = np.repeat(np.array(own, np.uint32), [len(sets[i]) for i in own])
        order = np.argsort(tok, kind="stable")
        tok, idx = tok[order], idx[order]
        starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(tok)))
        hot = np.repeat(many >= HOT, many)
        hot_tok, hot_idx = tok[hot], idx[hot]
        head = starts[many >= HOT]
        count = np.ones(len(tok), np.uint32)
        count[head] = many[many >= HOT]
        keep = ~hot
        keep[head] = True
        idx = idx.copy()
        idx[head] = BY_COUNT
        tok, idx, count = tok[keep], idx[keep], count[keep]
        part = ((tok >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(shards + 1))
        rows = [
            row(k, block, planes(np.diff(tok[i:j], prepend=np.uint64(0))), planes(idx[i:j]), planes(count[i:j]))
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:]))
            if j > i
        ]
        about = {
            "id": np.array([0 if x is None else x for x in ids], np.int64),
            "null": np.array([x is None for x in ids], np.uint8),
            "key": np.frombuffer(b"".join(keys), np.uint8),
            "n": np.array([len(s) for s in sets], np.int64),
            "rep": rep,
            "sig": np.frombuffer(b"".join(sigs), np.uint8),
            "hot_tok": hot_tok,
            "hot_idx": hot_idx,
        }
        return to_batch([*rows, row(-1 - block % shards, block, to_bytes(about), b"", b"")])

    def run(batches):
        from pyspark import TaskContext

        shingler, block = Shingler(size), TaskContext.get().partitionId() << 24
        for b in slices(batches):
            ids, keys, sets, n = [], [], [], 0
            for i, key, t in zip(*(c.to_pylist() for c in b.columns)):
                ids.append(i)
                keys.append(key)
                sets.append(shingler.hashes(t))
                n += len(sets[-1])
                if n >= STEP:
                    yield describe(block, ids, keys, sets)
                    ids, keys, sets, n, block = [], [], [], 0, block + 1
            if ids:
                yield describe(block, ids, keys, sets)
                block += 1

    return lambda batches: given_back(run(batches))


def count_shard(table: pa.Table) -> pa.Table:
    """Counts the documents of each shingle of a shard and tells each block of those that occur again."""
    part = table.column("part")[0].as_py()
    if part < 0:
        return table
    rows = table.to_pylist()
    tok = [np.cumsum(unplanes(r["a"], np.uint64), dtype=np.uint64) for r in rows]
    sizes = [len(t) for t in tok]
    tok = np.concatenate(tok)
    idx = np.concatenate([unplanes(r["b"], np.uint32) for r in rows])
    count = np.concatenate([unplanes(r["c"], np.uint32) for r in rows])
    own, back = np.unique(tok, return_inverse=True)
    df = np.bincount(back, count, len(own)).astype(np.int64)[back]
    level = np.floor(np.log2(np.maximum(df, 1))).astype(np.uint8)
    out, at = [], 0
    for r, n in zip(rows, sizes):
        s = slice(at, at + n)
        keep = df[s] > 1
        if keep.any():
            out.append(row(part, r["block"], planes(np.diff(tok[s][keep], prepend=np.uint64(0))), planes(idx[s][keep]), level[s][keep].tobytes()))
        at += n
    return pa.Table.from_batches([to_batch(out)])


def gather_block(table: pa.Table) -> pa.Table:
    """Puts a block's documents together again: each with its set's size, its signature and, if it may link, its repeated shingles, rarest first."""
    rows = table.to_pylist()
    about = from_buffer(next(r["a"] for r in rows if r["part"] < 0))
    rows = [r for r in rows if r["part"] >= 0]
    n, rep, sig, key = about["n"], about["rep"], about["sig"].tobytes(), about["key"].tobytes()
    toks: list = [None] * len(n)
    if rows:
        tok = np.concatenate([np.cumsum(unplanes(r["a"], np.uint64), dtype=np.uint64) for r in rows])
        idx = np.concatenate([unplanes(r["b"], np.uint32) for r in rows])
        level = np.concatenate([np.frombuffer(r["c"], np.uint8) for r in rows])
        counted = idx == BY_COUNT
        if counted.any():
            t, lv = tok[counted], level[counted]
            order = np.argsort(t)
            t, lv = t[order], lv[order]
            tok = np.concatenate([tok[~counted], about["hot_tok"]])
            idx = np.concatenate([idx[~counted], about["hot_idx"]])
            level = np.concatenate([level[~counted], lv[np.searchsorted(t, about["hot_tok"])]])
        order = np.lexsort((tok, level, idx))
        tok, idx = tok[order].astype(np.int64), idx[order]
        cuts = np.searchsorted(idx, np.arange(len(n) + 1))
        for i in np.unique(idx).tolist():
            own = tok[cuts[i] : cuts[i + 1]]
            if n[i] - len(own) < prefix_size(int(n[i])):
                toks[i] = own
    ids = pa.array([None if null else int(x) for x, null in zip(about["id"], about["null"])], pa.int64())
    sigs = pa.array([sig[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary())
    return pa.table({"doc_id": ids, "key": pa.array([key[16 * i : 16 * i + 16] for i in range(len(n))], pa.binary()), "n": pa.array(n), "sig": sigs, "toks": pa.array([toks[i] if rep[i] == i else None for i in range(len(n))], pa.list_(pa.int64()))})


def shingle_sets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    shards = pieces(docs, text, SHARD_BYTES, 64)
    sent = docs.select(F.col(doc_id).cast("long"), row_key(doc_id, text), text).mapInArrow(postings(shards, size), ROW)
    counted = sent.repartition(shards, "part").groupBy("part").applyInArrow(trimmed(count_shard), ROW)
    return counted.repartition(shards, "block").groupBy("block").applyInArrow(trimmed(gather_block), SETS)


def fits(na: str, nb: str):
    """Sizes at which two sets can link at all."""
    return (F.least(na, nb) * WHOLE) >= (F.greatest(na, nb) * LEAST)


def linked(same: Column, na: str, nb: str) -> Column:
    return same * (WHOLE + LEAST) >= (F.col(na) + F.col(nb)) * LEAST


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with sizes, repeated shingles and numbers of other shingles of both."""
    left, right = (classes.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("toks").alias(f"t{x}"), (F.col("n") - F.size("toks")).alias(f"u{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Shingles of one document only are in no intersection, so the repeated ones suffice."""
    both = compared(pairs, classes).where(fits("na", "nb"))
    return both.where(linked(F.size(F.array_intersect("ta", "tb")), "na", "nb")).select("a", "b")


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id``, ``n_links`` (how many other classes its class links with),
    the row's ``key`` (a hash of id and text) and ``kept_key``, the key of the component's row with the least id."""
    sets, classes, labels = labelled(docs, doc_id=doc_id, text=text, size=size)
    return results(sets, labels, degrees(labels, classes))


def labelled(docs: DataFrame, *, doc_id: str, text: str, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sets, the classes that may link and the component's label of each."""
    sets = stored(shingle_sets(docs, doc_id=doc_id, text=text, size=size), "jaccard-sets")
    classes = sets.where("toks IS NOT NULL AND n > 0").dropDuplicates(["sig"])
    share = F.expr(f"int(n - ceil({LEAST} * n / {WHOLE}) + 1 - (n - size(toks)))")
    classes = classes.select("sig", "n", "toks", share.alias("own"))
    classes = classes.withColumn("prefix", F.slice("toks", F.lit(1), F.greatest("own", F.lit(1)))).where("own > 0")
    group = F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>"))
    classes = stored(classes.withColumn("gid", F.unhex(F.md5(group.cast("binary")))), "jaccard-classes")
    members = classes.select("sig", "gid", "n")
    groups = classes.groupBy("gid").agg(F.min("sig").alias("head"), F.min("n").alias("n"), F.first(F.size("toks")).alias("size"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("many"))
    groups = stored(groups, "jaccard-groups")
    lists = groups.select("gid", "head", "n", "many", F.posexplode("prefix").alias("at", "tok"), "size")
    # A shingle's place in its document's order counts from 1 and after the shingles of that document alone.
    lists = lists.select("gid", "head", "n", "many", "tok", (F.col("at") + 1 + F.col("n") - F.col("size")).alias("pos"))
    lengths = lists.groupBy("tok").agg(F.sum("many").alias("length")).where("length > 1")
    lists = stored(lists.join(lengths, "tok"), "jaccard-lists")
    heads = groups.where("many > 1").select("gid", "head")
    inner = members.join(heads, "gid").where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    pivots = lists.groupBy("tok").agg(F.min(F.struct(F.xxhash64("gid").alias("x"), "gid", "head", "n")).alias("pivot"))
    tried = lists.join(pivots, "tok").where(F.col("gid") != F.col("pivot.gid")).where(fits("n", "pivot.n"))
    tried = tried.groupBy("gid", F.col("pivot.head").alias("a")).agg(F.count(F.lit(1)).alias("shared")).groupBy("gid").agg(F.max(F.struct("shared", "a")).alias("best"))
    outer = tried.join(members, "gid").select(F.col("best.a").alias("a"), F.col("sig").alias("b"))
    labels = relabel(members.select("sig", F.col("sig").alias("label")), stored(verified(inner.unionByName(outer).distinct(), classes), "jaccard-links"))
    labels = relabel(labels, small_lists(lists, members.join(labels, "sig"), classes))
    return sets, classes, long_lists(lists, members, labels, classes)


def degrees(labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, links) of every class that links with another one."""
    sizes = stored(labels.groupBy("label").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "jaccard-sizes")
    inside = labels.join(sizes, "label")
    two = inside.where("many = 2").select("sig", F.lit(1).cast("long").alias("links"))
    blocks = F.ceil(F.col("many") / BLOCK)
    dealt = inside.where("many > 2").select("sig", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("sig"), blocks).alias("at"))
    dealt = in_pairs(dealt.join(classes.select("sig", "n", "toks"), "sig"), "label")
    counted = dealt.groupBy("label", "i", "j").applyInArrow(trimmed(count_links), "sig binary, links long")
    return two.unionByName(counted.groupBy("sig").agg(F.sum("links").alias("links")))


def in_pairs(dealt: DataFrame, *keep: str) -> DataFrame:
    """Classes of blocks ``at`` of ``blocks``, once for each pair of blocks (i, j) that theirs is in."""
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(*keep, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "sig", "n", "toks")


def count_links(table: pa.Table) -> pa.Table:
    """The links of each class of one block with the others in it, or of each class of two blocks with those of the other one."""
    links = np.zeros(len(table), np.int64)
    for x, met in met_in_blocks(table):
        links[x] += len(met)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            links[met] += 1
    return pa.table({"sig": table.column("sig"), "links": links})


def met_in_blocks(table: pa.Table):
    """(x, the places of the classes of block j that link with x) of each class of block i."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    at, n = table.column("at").to_numpy(), table.column("n").to_numpy()
    toks = table.column("toks").combine_chunks()
    own, ids = np.unique(toks.flatten().to_numpy(), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(toks.value_lengths().to_numpy())])
    right = np.flatnonzero(at == j)
    starts = np.concatenate([[0], np.cumsum((ends[1:] - ends[:-1])[right])])
    if len(right):
        theirs = np.concatenate([ids[ends[y] : ends[y + 1]] for y in right])
        held = np.zeros(len(own), np.int32)
        for x in np.flatnonzero(at == i):
            mine = ids[ends[x] : ends[x + 1]]
            held[mine] = 1
            same = np.add.reduceat(held[theirs], starts[:-1])
            held[mine] = 0
            yield x, right[(same * (WHOLE + LEAST) >= (n[x] + n[right]) * LEAST) & (right != x)]


def small_lists(lists: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between different components from the lists of ``SMALL`` classes or fewer."""
    units = members.groupBy("gid", "label").agg(F.min("n").alias("n"))
    posts = lists.where(F.col("length") <= SMALL).select("tok", "gid", "pos").join(units, "gid")
    open_ = posts.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("tok")
    posts = posts.join(open_, "tok")
    left, right = (posts.select("tok", *(F.col(c).alias(f"{c}{x}") for c in ("gid", "label", "n", "pos"))) for x in "ab")
    overlap = F.ceil((F.col("na") + F.col("nb")) * LEAST / (LEAST + WHOLE))
    early = (F.col("posa") <= F.col("na") - overlap + 1) & (F.col("posb") <= F.col("nb") - overlap + 1)
    pairs = left.join(right, "tok").where("labela < labelb").where(fits("na", "nb")).where(early).select("gida", "labela", "gidb", "labelb").distinct()
    for x in "ab":
        pairs = pairs.join(members.select(F.col("gid").alias(f"gid{x}"), F.col("label").alias(f"label{x}"), F.col("sig").alias(x)), [f"gid{x}", f"label{x}"])
    return stored(verified(pairs.select("a", "b"), classes), "jaccard-links")


def long_lists(lists: DataFrame, members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """The labels after the links between different components from longer lists, by differences from the list's pivot.

    Links with the pivot itself are contracted first: most of a group of near copies is one component by then, and
    only classes of different components are paired.
    """
    owned = members.join(labels, "sig").join(classes.select("sig", (F.col("n") - F.size("toks")).alias("u")), "sig")
    posts = lists.where(F.col("length") > SMALL).select("tok", "gid").join(owned, "gid")
    open_ = posts.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("u", F.xxhash64("sig").alias("x"), "sig")).alias("pivot")).where("low <> high")
    pairs = posts.join(open_, "tok").select(F.col("pivot.sig").alias("a"), F.col("sig").alias("b")).where("a <> b").distinct()
    far = compared(pairs, classes).select("a", "b", "na", "nb", "ua", "ub", F.size("tb").alias("size"), F.array_except("tb", "ta").alias("plus"), F.reverse(F.array_except("ta", "tb")).alias("minus"))
    far = stored(far, "jaccard-far")
    labels = relabel(labels, far.where(linked(F.col("size") - F.size("plus"), "na", "nb")).select("a", "b"))
    labels = contracted(far, labels, classes)
    far = far.join(labels.select(F.col("sig").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("sig").alias("b"), F.col("label").alias("lb")), "b")
    posts = stored(posted(far), "jaccard-posts")
    crowded, held = (stored(x, "jaccard-crowded") for x in crowds(posts))
    found = sharing(posts.join(crowded, ["a", "d"], "left_anti")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return relabel(labels, stored(verified(found, classes).unionByName(linked_in_blocks(held, classes)), "jaccard-links"))


def differences() -> tuple[Column, Column]:
    """A class's differences from its pivot in order, and how many of the first ones its partners must share one of."""
    differ = F.concat("plus", F.transform("minus", lambda x: -x - 1))
    least = F.ceil((F.size("minus") * 4 + (F.size("plus") + F.col("ub") - F.col("ua")) * 3 + 1) / 7)
    return differ, (F.size("plus") + F.size("minus") - least + 1).cast("int")


def contracted(far: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """The labels after the links of a group whose classes link with each other but not with the list's pivot.

    Classes that share a first difference from the pivot are a list again. In lists of more than ``SMALL``, every class of
    another component is verified against one class of the list, in each round another one chosen by hash, so rows are linear in the
    lists. Rounds go on while a tenth of the classes tried link; the pairs that are left are found by ``sharing``.
    """
    differ, first = differences()
    posts = stored(far.where(first > 0).select("a", "b", F.explode(F.slice(differ, F.lit(1), first)).alias("d")), "jaccard-posts")
    turn = 0
    while True:
        own = posts.join(labels.select(F.col("sig").alias("b"), "label"), "b")
        lists = own.groupBy("a", "d").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("x"), "b", "label")).alias("pivot"))
        lists = lists.where((F.col("many") > SMALL) & (F.col("low") != F.col("high")))
        tried = own.join(lists, ["a", "d"]).where("label <> pivot.label").select(F.col("pivot.b").alias("a"), "b").distinct()
        tried = stored(tried, "jaccard-tried")
        links = stored(verified(tried, classes), "jaccard-links")
        found, all_ = links.count(), tried.count()
        if found:
            labels = relabel(labels, links)
        if found * 10 < all_ or not found:
            return labels
        turn += 1


def posted(far: DataFrame) -> DataFrame:
    """One row for each difference of a class ``b`` from its pivot ``a``: its place ``at``, whether it is among the ``first``, and whether b and its label are ``apart`` from the pivot.

    What a class has beyond the pivot comes rarest first; then what it lacks of the pivot, the pivot's most common shingles
    first, as few classes of the list lack those. Both orders are the same for all classes of a pivot.
    """
    differ, first = differences()
    apart = ~linked(F.col("size") - F.size("plus"), "na", "nb") & (F.col("la") != F.col("lb"))
    rows = far.select("a", "b", F.col("nb").alias("n"), F.col("lb").alias("l"), apart.alias("apart"), first.alias("k"), F.size("minus").alias("m"), F.size(differ).alias("size"), (F.col("size") - F.size("plus") + F.size("minus")).alias("p"), F.posexplode(differ).alias("at", "d"))
    return rows.select("a", "d", "b", "n", "l", "apart", (F.col("at") < F.col("k")).alias("first"), "m", "size", "p", "at").where("apart OR first")


def crowds(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists (a, d) whose pairs of different components are too many to list, and the classes (a, b, l) in them with the number of ``blocks`` they are compared in.

    A list is one if its pairs are more than ``SMALL`` times its rows. The lists of a pivot are compared in blocks where
    that makes fewer rows than their pairs.
    """
    both = posts.groupBy("a", "d", "l").agg(F.sum(F.col("apart").cast("long")).alias("x"), F.sum(F.col("first").cast("long")).alias("y"))
    lists = both.groupBy("a", "d").agg((F.sum("x") * F.sum("y") - F.sum(F.col("x") * F.col("y"))).alias("pairs"), (F.sum("x") + F.sum("y")).alias("many"))
    lists = stored(lists.where(F.col("pairs") > F.col("many") * SMALL).select("a", "d", "pairs"), "jaccard-crowded")
    held = stored(posts.join(lists, ["a", "d"]).select("a", "b", "l").distinct(), "jaccard-held")
    # Some blocks are there for small crowds, too, so that they are several tasks' work.
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.least(F.ceil(F.col("many") / LEAST_BLOCK), F.lit(BLOCKS)))
    sizes = held.groupBy("a").agg(F.count(F.lit(1)).alias("many")).select("a", (F.col("many") * blocks).alias("rows"), blocks.alias("blocks"))
    chosen = lists.groupBy("a").agg(F.sum("pairs").alias("pairs")).join(sizes, "a").where("pairs > rows").select("a", "blocks")
    return lists.join(chosen, "a").select("a", "d"), held.join(chosen, "a")


def linked_in_blocks(held: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all components of ``held`` that any of its pairs link; each two blocks of a pivot's classes are compared in arrays, without a row for each pair."""
    dealt = held.select("a", F.col("b").alias("sig"), "l", "blocks", F.pmod(F.xxhash64("b"), "blocks").alias("at"))
    dealt = in_pairs(dealt.join(classes.select("sig", "n", "toks"), "sig"), "a", "l")
    return dealt.groupBy("a", "i", "j").applyInArrow(trimmed(first_links), "a binary, b binary")


def first_links(table: pa.Table) -> pa.Table:
    """Links between the components of one block's classes, or of one block's with another's, until no further one joins two of them."""
    _, own = np.unique(np.array(table.column("l").to_pylist(), object), return_inverse=True)
    sig, found = table.column("sig").to_pylist(), []
    for x, met in met_in_blocks(table):
        for y in met:
            if own[x] != own[y]:
                found.append((sig[x], sig[y]))
                own[own == own[y]] = own[x]
    return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})


def sharing(posts: DataFrame) -> DataFrame:
    """Rows (x, y) of classes of different components that share a difference from their pivot that is one of y's first, x being apart from the pivot."""
    side = lambda rows, x: rows.select("a", "d", "apart", *(F.col(c).alias(f"{c}{x}") for c in ("n", "l", "m", "size", "p", "at")), F.col("b").alias(x))
    probes, index = side(posts.where("apart"), "x").drop("apart"), side(posts.where("first"), "y")
    # A linking pair shares so many differences that its first shared one is not late in either.
    need = F.greatest(F.ceil((F.col("nx") + F.col("ny")) * LEAST / (LEAST + WHOLE)) - F.col("px") + F.col("mx") + F.col("my"), F.lit(1))
    early = (F.col("atx") + need <= F.col("sizex")) & (F.col("aty") + need <= F.col("sizey"))
    once = ~F.col("apart") | (F.col("x") < F.col("y"))  # two classes that are apart would meet in both orders
    return probes.join(index, ["a", "d"]).where("lx <> ly").where(once).where(fits("nx", "ny")).where(early)


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, label) after more links: only links between different labels count, once for each pair of labels, so the graph shrinks as labels meet."""
    left, right = (labels.select(F.col("sig").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    edges = links.join(left, "a").join(right, "b").where("la <> lb").select(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct()
    found = components(stored(edges, "jaccard-edges"), a="la", b="lb").select(F.col("v").alias("label"), F.col("label").alias("new"))
    return stored(labels.join(found, "label", "left").select("sig", F.coalesce("new", "label").alias("label")), "jaccard-labels")


def results(sets: DataFrame, labels: DataFrame, degree: DataFrame) -> DataFrame:
    about = stored(labels.join(degree, "sig", "left").where("label <> sig OR links IS NOT NULL").select("sig", "label", "links"), "jaccard-about")
    rows = sets.select("doc_id", "key", "n", "sig").join(about, "sig", "left")
    rows = rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("label", "sig")).alias("root"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    least = rows.where("root IS NOT NULL").groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    least = stored(least.select("root", "first"), "jaccard-least")
    out = rows.join(least, "root", "left")
    own = lambda c, x: F.when(F.col("first").isNotNull(), F.col(f"first.{c}")).otherwise(F.col(c)).alias(x)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own("doc_id", "component_id"), "n_links", "key", own("key", "kept_key"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id. Rows that repeat id and text are one document."""
    sets, _, labels = labelled(docs, doc_id=doc_id, text=text)
    kept = results(sets, labels, labels.select("sig", F.lit(0).cast("long").alias("links")).limit(0)).where("key = kept_key").select(F.col("key").alias("__nd_key")).distinct()
    out = docs.withColumn("__nd_key", row_key(doc_id, text)).join(kept, "__nd_key", "left_semi")
    return out.dropDuplicates(["__nd_key"]).select(*docs.columns)
