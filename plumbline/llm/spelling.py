"""Spelling variants: words one edit apart, found by their rarest bigrams.

Words are counted over all texts. Every bigram has a rank by its number of occurrences in the words, rare first, and each word keeps the three
rarest of its positional bigrams (ties by bigram, then place). One edit spoils two bigrams at most, so two words one edit apart share
an untouched bigram among their three, at places one apart at most: if none of the three had its partner among the other's three, each
word would hold a partner of the other's that is ranked behind its own three, and then all of them are one
bigram, whose places would have to be in opposite orders in both words.

The edit lies wholly behind or wholly before that bigram. Behind: both words begin alike up to and with the bigram (same place).
Before: both end alike from the bigram on (place moved by the difference of lengths). So the join's keys are the shared bigram with the
parts of the word that must be equal (``keyed``), and pairs within one are verified by their edit distance in the join
itself. Keys with more than ``LONG`` words are cut into blocks, and each pair of blocks is a key of its own.

The form of a word is its nearest word of largest count, if that is ``times`` its own at least; roots follow forms in
stored rounds, a dozen at most, as counts grow tenfold a step.

Defined results: null text holds no words; a null id counts as empty text in the digest; texts of any length are
read whole; repeated rows count each; an empty table gives an empty result; ties of counts go to
the word first in code-point order; other columns of the input take no part.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import pieces, stored

LEAST = 7
RUN = r"[A-Za-zÀ-ÿ]"
#: The letters of a normalised word: a to z, then the code points C0 to FF.
LETTERS = 26 + 64
#: Bigrams a word keeps: one more than an edit can spoil.
PREFIX = 3
#: Letters next to a bigram, or at the word's other end, that go into a key.
NEXT = 2
LONG = 4096
PART_BYTES = 32 << 20
PART_ROWS = 200_000


def words(docs: DataFrame, *, doc_id: str, text: str, every: int, least: int = LEAST) -> DataFrame:
    """One row for each run of letters, lower-cased from A to Z, of ``least`` code points after the typo that its digest gives it: ``word``."""
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    one = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("run"))
    low = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    one = one.select("d", low.alias("run")).select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return one.select(F.when(F.col("h") % every == 0, typo).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every: int = 31, least: int = LEAST, fewest: int = 2) -> DataFrame:
    """(word, n) of the words that occur ``fewest`` times at least."""
    return words(docs, doc_id=doc_id, text=text, every=every, least=least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


def code(letter: Column) -> Column:
    """A letter's number, 0 to 89."""
    return F.ascii(letter) - F.when(F.ascii(letter) < 128, 97).otherwise(0xC0 - 26)


def grams(word: Column) -> Column:
    """A word's bigrams as numbers, by place. The letters are bound once, so that a long word is read once and not again for each place."""
    numbers = lambda w: F.transform(F.split(w, ""), code)
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * LETTERS + b)
    return F.transform(F.array(numbers(word)), pairs)[0]


def ranks(vocab: DataFrame) -> Column:
    """Bigrams' ranks, the rarest first, ties by number: an array of ``LETTERS ** 2`` whole numbers, whatever the corpus."""
    count = {r["g"]: r["n"] for r in vocab.select(F.explode(grams(F.col("word"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(LETTERS**2), key=lambda g: (count.get(g, 0), g))
    rank = [0] * LETTERS**2
    for r, g in enumerate(order):
        rank[g] = r
    return F.split(F.lit(",".join(map(str, rank))), ",").cast("array<int>")


def keyed(vocab: DataFrame) -> DataFrame:
    """Keys of a word by each of its ``PREFIX`` rarest positional bigrams: what must be equal in a word one edit away if the edit is not in that bigram.

    If the edit is behind the bigram, all up to the bigram is equal, and of the rest either the first ``NEXT`` letters or, if the edit is in
    those, the last ones; a rest too short for that (``2 * NEXT`` letters; one of just that many takes both forms, as its partner may be shorter) is
    left out of the key. Likewise before the bigram.
    """
    word, at, size = F.col("word"), F.col("own")["at"], F.length("word")
    rank = ranks(vocab)
    placed = F.transform("grams", lambda g, i: F.struct(F.element_at(rank, g + 1).alias("rank"), (i + 1).alias("at")))
    rows = vocab.select("word", grams(word).alias("grams")).select("word", F.slice(F.array_sort(placed), 1, PREFIX).alias("rare")).select("word", F.explode("rare").alias("own"))
    cut = lambda start, n: F.substring(word, start, n)
    start, first, last, n = F.lit(1), cut(F.lit(1), F.lit(NEXT)), cut(size - NEXT + 1, F.lit(NEXT)), 2 * NEXT
    head, tail, behind, before = cut(start, at + 1), cut(at, size), size - at - 1, at - 1
    keys = F.array(
        F.when(behind <= n, F.concat(F.lit("0<"), head)), F.when(behind >= n, F.concat(F.lit("1<"), cut(start, at + 1 + NEXT))), F.when(behind >= n, F.concat(F.lit("2<"), head, F.lit(" "), last)),
        F.when(before <= n, F.concat(F.lit("0>"), tail)), F.when(before >= n, F.concat(F.lit("1>"), cut(at - NEXT, size))), F.when(before >= n, F.concat(F.lit("2>"), first, F.lit(" "), tail)),
    )
    return rows.select("word", F.explode(F.array_compact(keys)).alias("key"))


def blocked(rows: DataFrame, *, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join: keys of more than ``long`` words are cut into blocks by the word's hash, and a pair of blocks meets under one key.

    There are at most ``rows / long`` such keys.
    """
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > long).select("key", F.ceil(F.col("m") / F.lit(long)).cast("int").alias("blocks")), "spelling-long")
    many = sizes.count()
    if not many:
        side = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
        return side, side
    dealt = rows.join(F.broadcast(sizes) if many <= 100_000 else sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, all_ = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.select("word", "key", own.alias("i"), all_.alias("j")), dealt.select("word", "key", all_.alias("i"), own.alias("j"))


def near_pairs(vocab: DataFrame, *, long: int = LONG, parts: int = 8) -> DataFrame:
    """(a, b), once each and a before b, of words that one inserted, deleted or replaced code point sets apart."""
    rows = stored(keyed(vocab), "spelling-keys")
    left, right = blocked(rows, long=long)
    left = left.withColumnRenamed("word", "a").repartition(parts, "key", "i", "j")
    right = right.withColumnRenamed("word", "b").repartition(parts, "key", "i", "j")
    close = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return left.hint("merge").join(right, ["key", "i", "j"]).where(close).select("a", "b").distinct()


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", every: int = 31, times: int = 10, long: int = LONG) -> DataFrame:
    """One row a word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    vocab = stored(vocabulary(docs, doc_id=doc_id, text=text, every=every).repartition(pieces(docs, text, PART_BYTES, 8), "word"), "spelling-words")
    parts = max(8, math.ceil(vocab.count() * 2 * PREFIX / PART_ROWS))
    pairs = stored(near_pairs(vocab, long=long, parts=parts), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(vocab.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = counted.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("m"), "b")).alias("best"))
    rows = vocab.join(best.withColumnRenamed("a", "word"), "word", "left")
    m = -F.col("best")["col1"]
    is_form = m >= F.col("n") * times
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")["b"]).alias("form"), F.when(is_form, m).alias("form_n")), "spelling-forms")
    return rows.join(roots(rows), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(rows: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round follows one more form."""
    forms = rows.where("form IS NOT NULL").select("word", "form")
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("up"))
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while not (open_ := found.join(step, "root", "left_semi")).isEmpty():
        more = open_.join(step, "root").select("word", F.col("up").alias("root"))
        found = stored(found.join(step, "root", "left_anti").select("word", "root").unionByName(more), "spelling-roots")
    return found
