"""Removal of repeated multi-line chunks with content-defined boundaries.

Lines are hashed; a rolling hash over the last ``WINDOW`` line hashes ends a chunk where its value
divides by ``DIVISOR``, so a line put in or taken out moves boundaries near it only. A line of
``LONG_LINE`` words or more is a passage of its own and is always a chunk by itself. A chunk counts if
it has two lines or more, or is such a long line. Of chunks that occur more than once anywhere, the
first by (doc_id, place) stays and every other whose bytes equal the first's is removed.

Chunks miss passages of a few short lines, whose first and last line are chunked with their neighbours. So
windows are compared as well: from each line the fewest lines that hold ``LONG_LINE`` words, and the fewest
that end with it. Every run of ``LONG_LINE`` words or more is the union of its windows, so a run that stands
in an earlier document goes whole, wherever boundaries fall. Within one document a window that overlaps its
first occurrence stays. Every line that goes has an equal earlier line, in the same surroundings.

Only hashes are shuffled to find repeats; texts are compared for repeats alone, and windows, which overlap,
by 128 bits of blake2b. Rows are matched by a hash of id and text. ``removed_chunks`` counts chunks all of
whose lines go, ``removed_lines`` all lines that go.

Defined results: null text stays null and has no lines; rows that repeat an id with the same text
share one fate (they are one document met twice); a null doc_id comes last; a text all of whose lines
go becomes the empty text; an empty table gives an empty result; other columns pass through, and
internal names start with ``__ld``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import given_back, row_key, slices, stored

WINDOW = 2
DIVISOR = 2
LONG_LINE = 50
LEAST_LINES = 2
MOST_LINES = 64
MASK = (1 << 64) - 1
#: Places of windows are numbered from here, those of chunks from 0.
RUNS = -(1 << 31)


def chunk_spans(lines: list[bytes]) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether it counts) of each chunk of a text."""
    out: list[tuple[int, int, bool]] = []
    start, before = 0, []

    def close(end: int, long: bool = False) -> None:
        nonlocal start, before
        if end > start:
            blank = not any(x.strip() for x in lines[start:end])
            out.append((start, end, (long or end - start >= LEAST_LINES) and not blank))
        start, before = end, []

    for i, line in enumerate(lines):
        if len(line) >= 2 * LONG_LINE - 1 and len(line.split()) >= LONG_LINE:
            close(i)
            close(i + 1, True)
            continue
        before = [*before[-(WINDOW - 1) :], xxhash.xxh3_64_intdigest(line)]
        rolled = 0
        for h in before:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & MASK
        if i + 1 - start >= LEAST_LINES and ((rolled >> 33) % DIVISOR == 0 or i + 1 - start >= MOST_LINES):
            close(i + 1)
    close(len(lines))
    return out


def run_spans(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of the windows of a text: two lines or more, neither the first nor the last one blank."""
    counts = [len(x.split()) for x in lines]
    at = [i for i, c in enumerate(counts) if c]
    out: set[tuple[int, int]] = set()
    for step in (1, -1):
        order = at[::step]
        end = total = 0
        for start, i in enumerate(order):
            while end < len(order) and total < LONG_LINE:
                total += counts[order[end]]
                end += 1
            if total < LONG_LINE:
                break
            if end - start > 1:
                out.add((min(i, order[end - 1]), max(i, order[end - 1]) + 1))
            total -= counts[i]
    return sorted(out)


def split_lines(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split(b"\n")


HASHES = T.StructType([T.StructField(n, t) for n, t in (("__ld_key", T.BinaryType()), ("__ld_id", T.LongType()), ("__ld_at", T.IntegerType()), ("__ld_h1", T.LongType()), ("__ld_h2", T.LongType()))])


def chunk_hashes(keyed: DataFrame, text: str) -> DataFrame:
    """One row for each chunk that counts and each window: the row's key and id, the place and a 128-bit hash."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches):
        for b in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for key, doc, t in zip(*(c.to_pylist() for c in b.columns)):
                lines = split_lines(t)
                for at, (i, j, counts) in enumerate(chunk_spans(lines)):
                    if counts:
                        h = xxhash.xxh3_128_intdigest(b"\n".join(lines[i:j]))
                        for c, v in zip(cols, (key, doc, at, signed(h >> 64), signed(h & MASK))):
                            c.append(v)
                for at, (i, j) in enumerate(run_spans(lines), RUNS):
                    h = hashlib.blake2b(b"\n".join(lines[i:j]), digest_size=16).digest()
                    for c, v in zip(cols, (key, doc, at, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True))):
                        c.append(v)
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], HASHES.names)

    return keyed.select("__ld_key", "__ld_id", text).mapInArrow(lambda batches: given_back(run(batches)), HASHES)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text and ``n_lines``, ``removed_chunks`` and ``removed_lines``."""
    docs = docs.drop("n_lines", "removed_chunks", "removed_lines")
    names = docs.columns
    keyed = docs.withColumn("__ld_key", row_key(doc_id, text)).withColumn("__ld_id", F.col(doc_id).cast("long"))
    # Rows that repeat id and text are one document met twice: their chunks are told apart by key and place, and count once.
    found = chunk_hashes(keyed, text)
    place = F.struct(F.col("__ld_id").isNull(), "__ld_id", "__ld_key", "__ld_at")
    repeated = (
        found.groupBy("__ld_h1", "__ld_h2")
        .agg(F.min(place).alias("__ld_first"), F.max(place).alias("__ld_last"))
        .where(F.col("__ld_first") != F.col("__ld_last"))
        .select("__ld_h1", "__ld_h2", F.col("__ld_first.__ld_key").alias("__ld_key1"), F.col("__ld_first.__ld_at").alias("__ld_at1"))
    )
    own = F.col("__ld_key") == F.col("__ld_key1")
    hits = found.join(repeated, ["__ld_h1", "__ld_h2"]).select(
        "__ld_key", "__ld_at", *(F.when(F.col("__ld_at") >= 0, F.col(h)).alias(h) for h in ("__ld_h1", "__ld_h2")),
        (own & (F.col("__ld_at") == F.col("__ld_at1"))).alias("__ld_is1"), F.when(own, F.col("__ld_at1")).alias("__ld_own1"),
    )
    hits = stored(hits.where("__ld_at >= 0 OR NOT __ld_is1"), "line-hits")
    by_row = hits.where("__ld_at >= 0").groupBy("__ld_key").agg(F.collect_set(F.struct("__ld_at", "__ld_h1", "__ld_h2", "__ld_is1")).alias("__ld_hits"))
    texts = stored(chunk_texts(keyed.join(by_row, "__ld_key"), text), "line-texts")
    first = texts.where("__ld_is1").groupBy("__ld_h1", "__ld_h2").agg(F.min("__ld_text").alias("__ld_text1"))
    same = texts.where("NOT __ld_is1").join(first, ["__ld_h1", "__ld_h2"]).where(F.col("__ld_text") == F.col("__ld_text1"))
    gone = same.select("__ld_key", "__ld_at", F.lit(None).cast("int").alias("__ld_own1")).unionByName(hits.where("__ld_at < 0").select("__ld_key", "__ld_at", "__ld_own1"))
    gone = gone.groupBy("__ld_key").agg(F.collect_set(F.struct("__ld_at", "__ld_own1")).alias("__ld_gone"))
    return rewrite(keyed.join(gone, "__ld_key", "left"), names, text)


def chunk_texts(hit: DataFrame, text: str) -> DataFrame:
    """The bytes of the chunks that ``__ld_hits`` names."""
    schema = T.StructType([*HASHES.fields[:1], *HASHES.fields[2:], T.StructField("__ld_is1", T.BooleanType()), T.StructField("__ld_text", T.BinaryType())])

    def run(batches):
        for b in slices(batches):
            cols: list[list] = [[] for _ in schema]
            for key, t, hits in zip(*(c.to_pylist() for c in b.columns)):
                lines = split_lines(t)
                spans = chunk_spans(lines)
                for h in hits:
                    i, j, _ = spans[h["__ld_at"]]
                    for c, v in zip(cols, (key, h["__ld_at"], h["__ld_h1"], h["__ld_h2"], h["__ld_is1"], b"\n".join(lines[i:j]))):
                        c.append(v)
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], schema.names)

    return hit.select("__ld_key", text, "__ld_hits").mapInArrow(lambda batches: given_back(run(batches)), schema)


def gone_lines(lines: list[bytes], gone: list[dict]) -> set[int]:
    """The lines of a text that go with the places in ``gone``."""
    spans, runs, drop = chunk_spans(lines), run_spans(lines), set()
    for g in gone:
        at, own = g["__ld_at"], g["__ld_own1"]
        i, j = spans[at][:2] if at >= 0 else runs[at - RUNS]
        if at >= 0 or own is None or i >= runs[own - RUNS][1]:
            drop.update(range(i, j))
    return drop


def rewrite(marked: DataFrame, names: list[str], text: str) -> DataFrame:
    own = [c for c in names if c != text]
    schema = T.StructType([*marked.select(*names).schema.fields, *(T.StructField(n, T.IntegerType()) for n in ("n_lines", "removed_chunks", "removed_lines"))])

    def run(batches):
        for b in slices(batches):
            out, counts = [], []
            for t, gone in zip(b.column(len(own)).to_pylist(), b.column(len(own) + 1).to_pylist()):
                lines = split_lines(t)
                if gone:
                    spans, drop = chunk_spans(lines), gone_lines(lines, gone)
                    out.append(b"\n".join(x for k, x in enumerate(lines) if k not in drop).decode("utf-8", "surrogatepass"))
                    counts.append((len(lines), sum(drop.issuperset(range(i, j)) for i, j, _ in spans), len(drop)))
                else:
                    out.append(t)
                    counts.append((len(lines), 0, 0))
            rest = dict(zip(own, b.columns))
            cols = [rest[n] if n != text else pa.array(out, pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([c[k] for c in counts], pa.int32()) for k in range(3))], schema.names)

    return marked.select(*own, text, "__ld_gone").mapInArrow(lambda batches: given_back(run(batches)), schema)
