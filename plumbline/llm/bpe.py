"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the tokenizer's pattern; each distinct piece becomes a row of byte ids in the
matrix of its length bucket. In every round each row looks up the rank of all its neighbouring pairs
in an open-addressing hash table, merges its leftmost pair of lowest rank, and is compacted by one
column; rows without a pair leave. Rows of the buckets over ``LONG`` bytes are cut into blocks with their least
ranks, and a round merges as many leftmost pairs of one rank as no other pair can come between.

A unit is an optional space and the following run without white space. No match of the pattern
crosses a unit's border, so a unit's ids are looked up by its text. The look-up table is an
accelerator of bounded bytes, emptied when full and when a task ends.

Defined results: null text counts as empty and has no ids; ids decode to exactly the text's UTF-8
bytes; repeated rows are encoded alike; a text of any length is encoded whole, in one step of its own if it
is longer than a step; an empty table gives an empty result. The input's other columns pass through; columns of the names
``ids`` and ``decoded`` (and those of the digests) are replaced. Among pairs of one rank the leftmost goes first.
"""

from __future__ import annotations

import base64
import itertools
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import trim

#: White space as the pattern's \s means it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG = 96
BLOCK = 64
#: Look-up tables are emptied beyond so many bytes of keys and ids, and steps hold about so many characters, matrices so many cells.
KEEP_BYTES = 40 << 20
CHARS_A_STEP = 1_000_000
CELLS = 500_000
#: Bytes that an entry of a look-up table takes besides its key and ids.
EACH = 160


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probing, built and read in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.keys[at] == np.uint64(2**64 - 1)
            self.keys[at[free]] = keys[left[free]]  # of several for a slot the last stays
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for a key that is absent."""
        at = self.slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        more = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        at = at[more]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[more]
            out[more[hit]] = self.values[at[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            more, at = more[go], at[go]
        return out


class Tokenizer:
    """Encodes and decodes by the ranks of a file of lines "base64 rank"."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes_of = dict(zip(self.ranks.values(), self.ranks))
        self.pattern = regex.compile(pattern)
        self.unit = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a = np.array(pairs, np.int64).reshape(-1, 3)
        self.pairs = PairTable(self.key(a[:, 0], a[:, 1]), a[:, 2].astype(np.int32))
        self.pieces: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.piece_bytes = self.unit_bytes = 0

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def merge_bucket(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of about one length; every round merges one pair in each row that has one."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        m = np.full((len(rows), int(size.max())), -1, np.int32)
        inside = np.arange(m.shape[1]) < size[:, None]
        m[inside] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        none = np.int32(2**31 - 1)
        rank = np.full((len(rows), max(1, m.shape[1] - 1)), none, np.int32)
        if m.shape[1] > 1:
            both = inside[:, 1:]
            got = self.pairs.get(self.key(m[:, :-1][both], m[:, 1:][both]))
            rank[both] = np.where(got < 0, none, got)
        out: list = [None] * len(rows)
        own = np.arange(len(rows))
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(own)), at]
            live = best != none
            if not live.all():
                for i in np.flatnonzero(~live):
                    out[own[i]] = m[i, : size[i]].copy()
                if not live.any():
                    return out
                m, rank, size, own, at, best = m[live], rank[live], size[live], own[live], at[live], best[live]
            size = size - 1
            width = int(size.max())
            shift = np.arange(width) > at[:, None]
            m2 = np.where(shift, m[:, 1 : width + 1], m[:, :width])
            here = np.arange(len(own))
            m2[here, at] = best
            n = max(1, width - 1)
            wide = np.concatenate([rank, np.full((len(own), 1), none, np.int32)], 1)
            rank = np.where(np.arange(n) > at[:, None] - 0, wide[:, 1 : n + 1], wide[:, :n])
            m = m2
            ids = self.pairs.get  # only the pairs beside the merged one change
            for side in (-1, 0):
                i = np.flatnonzero((at + side >= 0) & (at + side + 1 < size))
                c = at[i] + side
                got = ids(self.key(m[i, c], m[i, c + 1]))
                rank[i, c] = np.where(got < 0, none, got)
            i = np.flatnonzero(at + 1 >= size)  # the merged id is the row's last: no pair starts there
            rank[i[at[i] < n], at[i[at[i] < n]]] = none

    def merge_wide(self, rows: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces: rows of blocks of ``BLOCK`` places with each block's least rank, merged ids linked.

        A round finds each row's least rank among the blocks' and merges its occurrences from left to right, up to
        the first whose merge makes a pair that must come before the next one. So a round is several
        leftmost merges in turn, and costs no more than the blocks it touches and a look at the minima.
        """
        none = np.int32(2**31 - 1)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        width = int(-(-size.max() // BLOCK) * BLOCK)
        end = len(rows) * width  # stands for no neighbour
        starts = np.arange(len(rows)) * width
        full = (np.arange(width) < size[:, None]).ravel()
        m = np.full(end + 1, -1, np.int32)
        m[:-1][full] = self.byte_id[np.frombuffer(b"".join(rows), np.uint8)]
        after, before = np.arange(1, end + 2), np.arange(-1, end)
        after[starts + size - 1] = before[starts] = after[end] = before[end] = end
        rank = np.full(end, none, np.int32)
        at = np.flatnonzero(full & (after[:-1] < end))
        rank[at] = self.rank_of(m[at], m[after[at]])
        rank = rank.reshape(-1, BLOCK)
        least = rank.min(1)
        flat, least_of = rank.reshape(-1), least.reshape(len(rows), -1)
        while True:
            best = least_of.min(1)
            block = np.flatnonzero((least_of == np.where(best == none, -1, best)[:, None]).ravel())
            if not len(block):
                break
            which, place = np.nonzero(rank[block] == best[block * BLOCK // width][:, None])
            at = block[which] * BLOCK + place
            chain = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chain.any():  # of overlapping occurrences every second one goes
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(chain, 0, i))) % 2 == 0]
            r = best[at // width]
            right, left = after[at], before[at]
            far = after[right]
            beside = m[left]
            beside[1:] = np.where(right[:-1] == left[1:], r[:-1], beside[1:])
            early = np.where(left < end, self.rank_of(beside, r), none) <= r
            early |= np.where(far < end, self.rank_of(r, m[far]), none) <= r
            if early.any():
                row = at // width
                ahead = np.cumsum(early) - early
                keep = ahead == ahead[np.searchsorted(row, row)]
                at, r, right, far = at[keep], r[keep], right[keep], far[keep]
            m[at], m[right], flat[right] = r, -1, none
            after[at], before[far] = far, at
            before[end] = end
            left = before[at]
            flat[at] = np.where(far < end, self.rank_of(r, m[far]), none)
            i = left < end
            flat[left[i]] = self.rank_of(m[left[i]], r[i])
            block = np.unique(np.concatenate([at, right, left[i]]) // BLOCK)
            least[block] = rank[block].min(1)
        return [x[x >= 0] for x in m[:-1].reshape(len(rows), width)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        got = self.pairs.get(self.key(left, right))
        return np.where(got < 0, np.int32(2**31 - 1), got)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            else:  # buckets of 4 bytes up to LONG, then of a power of two
                buckets.setdefault((len(p) + 3) // 4 if len(p) <= LONG else -len(p).bit_length(), []).append(i)
        for bucket, own in buckets.items():
            merge = self.merge_wide if bucket < 0 else self.merge_bucket
            step = max(1, CELLS // max(len(pieces[i]) for i in own))
            for k in range(0, len(own), step):
                for i, ids in zip(own[k : k + step], merge([pieces[i] for i in own[k : k + step]])):
                    out[i] = ids
        return out

    def learn(self, units: list[str]) -> None:
        """Adds the ids of new units to the look-up table."""
        split = {u: [p.encode() for p in self.pattern.findall(u)] for u in units}
        if self.piece_bytes > KEEP_BYTES:
            self.pieces.clear()
            self.piece_bytes = 0
        new = list({p for ps in split.values() for p in ps} - self.pieces.keys())
        self.pieces.update(zip(new, (x.tobytes() for x in self.merge(new))))
        self.piece_bytes += sum(len(p) + len(self.pieces[p]) + EACH for p in new)
        for u, ps in split.items():
            ids = self.units[u] = b"".join([self.pieces[p] for p in ps])
            self.unit_bytes += len(u) + len(ids) + EACH

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = list(map(self.unit.findall, texts))
        if self.unit_bytes > KEEP_BYTES:
            self.units.clear()
            self.unit_bytes = 0
        new = set(itertools.chain.from_iterable(split)).difference(self.units)
        if new:
            self.learn(list(new))
        get = self.units.__getitem__
        return [np.frombuffer(b"".join(map(get, us)), np.int32) for us in split]

    def forget(self) -> None:
        """Empties the look-up tables, as a worker keeps its tokenizer between tasks."""
        self.pieces, self.units, self.piece_bytes, self.unit_bytes = {}, {}, 0, 0

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def own(run, path: str, pattern: str):
    """``run`` with the look-up tables emptied and their memory given back when the task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            tokenizer(path, pattern).forget()
            trim()

    return task


def by_chars(texts: list[str], most: int):
    """Slices of rows with about ``most`` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if len(texts) > start:
        yield start, len(texts)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``, an array of int."""
    rest = [c for c in docs.columns if c != ids]
    schema = docs.select(*rest).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches):
        tok = tokenizer(path, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(rest.index(text)).to_pylist()]
            for i, j in by_chars(texts, CHARS_A_STEP):
                got = tok.encode_batch(texts[i:j])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                flat = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.ListArray.from_arrays(pa.array(ends), flat)], [*rest, ids])

    return docs.select(*rest).mapInArrow(own(run, path, pattern), schema)


def decode(tokens: DataFrame, path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``out``, the bytes that the ids stand for; null ids give null."""
    rest = [c for c in tokens.columns if c != out]
    schema = tokens.select(*rest).schema.add(out, T.BinaryType())

    def run(batches):
        tok = tokenizer(path, pattern)
        for b in batches:
            col = b.column(rest.index(ids))
            flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            valid = col.is_valid().to_pylist()
            got = [tok.decode(flat[ends[i] : ends[i + 1]]) if ok else None for i, ok in enumerate(valid)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*rest, out])

    return tokens.select(*rest).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``ids`` and ``decoded``; encoding and decoding share one pass over the rows."""
    rest = [c for c in docs.columns if c not in ("ids", "decoded", text)]
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())

    def run(batches):
        tok = tokenizer(path, pattern)
        for b in batches:
            texts = [x or "" for x in b.column(len(rest)).to_pylist()]
            for i, j in by_chars(texts, CHARS_A_STEP):
                got = tok.encode_batch(texts[i:j])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
                back = pa.array([tok.decode(x) for x in got], pa.binary())
                flat = pa.array(np.concatenate(got), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[: len(rest)], pa.ListArray.from_arrays(pa.array(ends), flat), back], [*rest, "ids", "decoded"])

    return docs.select(*rest, text).mapInArrow(own(run, path, pattern), schema)


def digests(tokens: DataFrame) -> DataFrame:
    """The digest columns of a round trip, made in the JVM."""
    return tokens.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")
