"""N-gram language model of order 3 in an Elias-Fano trie, trained and queried on the same tables.

Level 1 holds the words: their 64-bit hashes in an Elias-Fano sequence (a word's rank is its id) and their
counts. Level 2 holds the pairs seen: the ids of the contexts and monotone pointers to where each one's
followers begin, both Elias-Fano coded, the followers' ids packed and sorted within each context, the
quantised log10 of each pair's discounted probability and of the mass it leaves to shorter contexts. Level 3
holds the triples seen: pointers from the pairs, the followers' ids, and their quantised discounted
probabilities. A query finds its context, follows the pointers and searches the range between them, so ids are looked up
relative to their context. Levels are cut into shards, one file each in the folder the cluster shares;
tasks map those they need into memory (copied to a local file first, and unlinked, where the folder is
in a store that cannot be mapped), so memory stays small and pages can go.

Probabilities are interpolated with absolute discounting (``DISCOUNT``, D): p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), and for
a context h with shorter context h', p(w|h) = max(c(hw) - D, 0) / c(h) + D * n(h) / c(h) * p(w|h') with n(h) the number of
distinct followers of h; an unseen context gives p(w|h'). They sum to one over the words and one unknown
word. The beginning of a text is a context of its own. All training rows count; nothing is pruned.

Counts travel as packed, sorted, delta-coded blocks, summed per block before the shuffle: words, then
triples, whose sums are the pairs. A block addresses at most ``FAN`` groups of shards; beyond that many shards
the groups are merged and dealt out again, so rows grow with the input. A shard of
pairs is a hash of the context; the followers of a context that holds more than a shard's share are
dealt over several shards by ranges of their ids, and the mass of such a context is summed over its shards.

Defined results: null text counts as empty; every text ends with one end token; a text of any length is read whole;
without training rows every token has probability 1 and scores are 0; repeated rows count as often as they occur; a null id
has the fold of the empty text; an empty table gives an empty result; input columns of the result's names are
replaced, others pass through ``score``. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import crc_mod, given_back, pieces, shared_dir
from plumbline.llm.elias_fano import EliasFano, Ids, from_buffer, to_bytes

FOLDS = 10
STEP = 3_000_000
#: Bytes of a step that is scored: a step looks into every shard, so the more texts share one, the fewer places in memory each of them touches.
SCORED = 6_000_000
SHARD_BYTES = 14 << 20
#: Groups of shards that a block addresses at most.
FAN = 256
#: No word holds a space, so the end token is none of them.
END = b" end"
LEVELS = 65_536
LEAST_LOG = -16.0
DISCOUNT = 0.75


#: Words over so many bytes are hashed one by one.
SHORT = 64
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary strings: eight bytes of all words at a time, each mixed in by multiplications and shifts."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    low, high = int(ends[0]), int(ends[-1])
    raw = np.zeros(high - low + 8, np.uint8)
    if high > low:
        raw[:-8] = np.frombuffer(words.buffers()[2], np.uint8)[low:high]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    size, start = np.diff(ends), ends[:-1] - low
    k0, k1, k2 = map(np.uint64, MIX)
    out = (size.astype(np.uint64) + np.uint64(1)) * k0
    todo = np.flatnonzero((size > 0) & (size <= SHORT))
    at, left, h = start[todo], size[todo], out[todo]
    while len(todo):
        part = np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        h = (h ^ (eight[at] << part)) * k1  # what follows a word is shifted out
        h = (h ^ (h >> np.uint64(29))) * k2
        h ^= h >> np.uint64(32)
        out[todo] = h
        more = left > 8
        todo, at, left, h = todo[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
    return out


def word_hash(word: bytes) -> int:
    return END_HASH if word == END else int(hashes_of(pa.array([word], pa.binary()))[0])


END_HASH = xxhash.xxh3_64_intdigest(END)


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


# ---- files -----------------------------------------------------------------------------------------------------


def put(folder: str, name: str, raw: bytes) -> None:
    """Writes a whole file or none, so a task may run twice; its second file would be the same."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(raw)
    if store.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
        store.move(own, f"{path}/{name}")
    else:
        store.delete_file(own)


def mapped(folder: str, name: str):
    """A file of the shared folder as a memory map."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    with store.open_input_stream(f"{path}/{name}") as f, tempfile.NamedTemporaryFile(delete=False) as own:
        while part := f.read(1 << 22):
            own.write(part)
    try:
        return np.memmap(own.name, np.uint8, "r")
    finally:
        os.unlink(own.name)


# ---- packed counts ---------------------------------------------------------------------------------------------

#: ``many`` and ``next`` are empty where keys are words: a pair's triples are its ``many`` next ids with their counts.
BLOCK = T.StructType([T.StructField("shard", T.IntegerType()), *(T.StructField(x, T.BinaryType()) for x in ("keys", "many", "next", "counts"))])
ENTRIES_A_MERGE = 1_500_000
#: Entries that a merge sorts at once.
SORTED = 400_000


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array by place: small numbers leave runs of zeros, which the shuffle's codec removes."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, -1).T).view(kind).ravel()


class Counts:
    """Sorted distinct keys with counts; for pairs the counts of their triples, ``many`` a pair, sorted by the next id."""

    def __init__(self, keys, counts, many=None, after=None):
        self.keys, self.counts, self.many, self.after = keys, counts, many, after

    @classmethod
    def of_words(cls, keys: np.ndarray, counts: np.ndarray) -> Counts:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(first_of_runs(keys))
        return cls(keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts)

    @classmethod
    def of_triples(cls, keys: np.ndarray, after: np.ndarray, counts: np.ndarray, bits: int) -> Counts:
        """From triples (pair's key, next id of ``bits`` bits, count) in any order."""
        order = np.argsort(keys)
        keys = keys[order]
        new = first_of_runs(keys)
        both = (np.cumsum(new).astype(np.uint64) - np.uint64(1)) << np.uint64(bits) | after[order].astype(np.uint64)
        again = np.argsort(both)
        both, counts = both[again], counts[order[again]]
        starts = np.flatnonzero(first_of_runs(both))
        both = both[starts]
        keys = keys[new]
        return cls(keys, np.add.reduceat(counts, starts) if len(starts) else counts, np.bincount((both >> np.uint64(bits)).astype(np.int64), minlength=len(keys)), both & np.uint64((1 << bits) - 1))

    def rows(self, shard: np.ndarray) -> pa.RecordBatch:
        """One packed row for each shard; ``shard`` is that of each key, below 65,536."""
        wide = shard.astype(np.uint16)
        order = np.argsort(wide, kind="stable")
        shard, keys, counts, many, after = shard[order], self.keys[order], self.counts, self.many, self.after
        if many is None:
            counts = counts[order]
        else:
            own = np.argsort(np.repeat(wide, many), kind="stable")
            counts, after, many = counts[own], after[own], many[order]
        cuts = np.append(np.flatnonzero(first_of_runs(shard)), len(shard))
        ends = cuts if many is None else np.concatenate([[0], np.cumsum(many)])[cuts]
        kind = np.uint32 if after is None or not len(after) or int(after.max()) < 1 << 32 else np.uint64
        rows = []
        for i, j, k, m in zip(cuts[:-1], cuts[1:], ends[:-1], ends[1:]):
            rest = (b"", b"") if many is None else (planes(many[i:j].astype(np.uint32)), planes(after[k:m].astype(kind)))
            rows.append((planes(np.diff(keys[i:j], prepend=np.uint64(0))), *rest, planes(counts[k:m].astype(np.uint64 if counts[k:m].max() >> 32 else np.uint32))))
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]].astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], BLOCK.names)

    @classmethod
    def merged(cls, rows: list[tuple], bits: int) -> Counts:
        """The sum of packed rows (keys, many, next, counts)."""
        keys = [np.cumsum(unplanes(r[0], np.uint64), dtype=np.uint64) for r in rows]
        if not rows[0][1]:
            return cls.of_words(np.concatenate(keys), np.concatenate([numbers(r[3], len(k)) for r, k in zip(rows, keys)]))
        many = [unplanes(r[1], np.uint32) for r in rows]
        ends = [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in many]
        after, counts = ([packed(r[k], int(e[-1])) for r, e in zip(rows, ends)] for k in (2, 3))
        parts = max(1, -(-sum(int(e[-1]) for e in ends) // SORTED))
        some = np.sort(np.concatenate([k[::64] for k in keys]))
        cuts = np.unique(some[np.arange(1, parts) * len(some) // parts])
        at = [np.concatenate([[0], np.searchsorted(k, cuts), [len(k)]]) for k in keys]
        done = []
        for i in range(len(cuts) + 1):  # ranges of keys, one after another, so that little is sorted at once
            heads = [slice(a[i], a[i + 1]) for a in at]
            tails = [slice(e[a[i]], e[a[i + 1]]) for a, e in zip(at, ends)]
            own = cls.of_triples(
                np.repeat(np.concatenate([k[s] for k, s in zip(keys, heads)]), np.concatenate([m[s] for m, s in zip(many, heads)])),
                np.concatenate([x[s] for x, s in zip(after, tails)]),
                np.concatenate([x[s] for x, s in zip(counts, tails)]).astype(np.int64),
                bits,
            )
            done.append((own.keys, own.counts, own.many, own.after))
        return cls(*map(np.concatenate, zip(*done)))


def packed(raw: bytes, n: int) -> np.ndarray:
    return unplanes(raw, np.uint32 if len(raw) == 4 * n else np.uint64)


def numbers(raw: bytes, n: int) -> np.ndarray:
    return packed(raw, n).astype(np.int64)


def first_of_runs(a: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)


def by_shard(rows: DataFrame, n: int, shard_of, bits: int) -> DataFrame:
    """Packed rows dealt to the partitions of their shards, each in one partition.

    Up to ``FAN`` shards they are addressed at once. Beyond, ``rows`` carry a group of shards; rows of a group (spread by a salt over
    as many partitions as its share of all, however few the groups) are merged up to ``ENTRIES_A_MERGE`` entries and dealt out to the group's
    shards or smaller groups by ``shard_of``, level by level.
    """
    level = levels(n)
    while level > 1:
        level -= 1
        step = FAN ** (level - 1)

        def finer(batches, step=step):
            have: dict[int, list] = {}
            size: Counter = Counter()

            def out(g: int) -> pa.RecordBatch:
                own = Counts.merged(have.pop(g), bits)
                del size[g]
                return parted(own, shard_of(own.keys) // step)

            for b in batches:
                for g, *r in zip(*(c.to_pylist() for c in b.columns)):
                    have.setdefault(g, []).append(r)
                    size[g] += len(r[3]) // 4
                    if size[g] >= ENTRIES_A_MERGE:
                        yield out(g)
                while sum(size.values()) >= 2 * ENTRIES_A_MERGE:
                    yield out(size.most_common(1)[0][0])
            for g in list(have):
                yield out(g)

        parts = max(8, math.ceil(n / 8))
        rows = rows.repartition(parts, "shard", F.pmod(F.hash("keys"), F.lit(salts(n, step * FAN, parts)))).mapInArrow(finer, BLOCK)
    return rows.repartition(n, "shard")


def salts(n: int, group: int, parts: int) -> int:
    """Into how many salts the rows of each group of ``group`` shards are cut, so that four keys or more go to each of ``parts`` partitions."""
    return math.ceil(4 * parts / math.ceil(n / group))


def levels(n: int) -> int:
    """How often blocks are dealt out so that each time at most ``FAN`` addresses follow from one."""
    k = 1
    while FAN**k < n:
        k += 1
    return k


def parted(own: Counts, shard: np.ndarray) -> pa.RecordBatch:
    """``rows`` for shards of any number: they are numbered within the block first."""
    there, dense = np.unique(shard, return_inverse=True)
    b = own.rows(dense)
    return b.set_column(0, "shard", pa.array(there[b.column(0).to_numpy()].astype(np.int32)))


# ---- the levels -------------------------------------------------------------------------------------------------


class Words:
    """Level 1, mapped shard by shard: hash -> (id, count)."""

    def __init__(self, model: dict):
        self.model, self.shards = model, {}
        self.bases = np.array([b for _, b, _ in model["words"]], np.int64)
        self.places = {own: k for k, (own, _, _) in enumerate(model["words"])}

    def shard(self, k: int):
        if k not in self.shards:
            a = from_buffer(mapped(self.model["folder"], f"words-{self.model['words'][k][0]}"))
            self.shards[k] = EliasFano.of(a, "hash"), a["count"]
        return self.shards[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for own, i in of_each(shard_of_hash(hashes, self.model["n1"])):
            if own in self.places:
                k = self.places[own]
                seq, count = self.shard(k)
                at = seq.locate(hashes[i])
                i, at = i[at >= 0], at[at >= 0]
                ids[i], counts[i] = self.bases[k] + at, count[at]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts by id; the id V stands for the beginning of a text."""
        out = np.full(len(ids), self.model["docs"], np.int64)
        part = np.searchsorted(self.bases, ids, "right") - 1
        for k in np.unique(part[ids < self.model["V"]]):
            i = np.flatnonzero((part == k) & (ids < self.model["V"]))
            out[i] = self.shard(int(k))[1][ids[i] - self.bases[k]]
        return out

    def p(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.model["N"] + 0.1 * (self.model["V"] + 1))


def shard_of_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash's upper 32 bits."""
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def parts_of_context(cv: np.ndarray, model: dict) -> np.ndarray:
    return np.clip(-(-cv * model["n2"] // max(1, model["N"])), 1, model["n2"])


def shard_of_context(v: np.ndarray, n: int) -> np.ndarray:
    return ((v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % n


def shard_of_pair(v: np.ndarray, w: np.ndarray, cv: np.ndarray, model: dict) -> np.ndarray:
    """A hash of the context; a context with more than a shard's share of tokens is dealt over several by ranges of w."""
    parts = parts_of_context(cv, model)
    return (shard_of_context(v, model["n2"]) + w * parts // max(1, model["V"])) % model["n2"]


class Step:
    """The tokens of some rows, one text after another: ``codes`` into the distinct words' ``hashes``, whose last one is the end token's, and each text's number of tokens."""

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))  # of space and 9 to 13, as WORD has it
        coded = parts.flatten().dictionary_encode()
        own, many = coded.indices.to_numpy(), parts.value_lengths().to_numpy()
        words = coded.dictionary.cast(pa.binary())
        empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)  # white space at a text's ends leaves empty strings
        keep = own != empty[0] if len(empty) else np.ones(len(own), bool)
        row = np.repeat(np.arange(len(many)), many)
        self.lengths = np.bincount(row[keep], minlength=len(many)) + 1
        ends = np.cumsum(self.lengths) - 1
        inside = np.ones(int(self.lengths.sum()), bool)
        inside[ends] = False
        self.codes = np.full(len(inside), len(words), np.int64)
        self.codes[inside] = own[keep]
        self.hashes = np.append(hashes_of(words), np.uint64(END_HASH))


def steps(batches, text: int, fold: int | None = None, most: int | None = None):
    """(batch, first row, row after the last, tokens) of slices of about ``most`` bytes (``STEP`` if not given); ``fold`` names a column of rows to leave out where it is 0, and slices without any others are left out."""
    most = most or STEP
    for b in batches:
        sizes = pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        i = 0
        while i < len(sizes):
            total, j = int(sizes[i]), i + 1
            while j < len(sizes) and total + sizes[j] <= most:
                total += int(sizes[j])
                j += 1
            own = b.column(text).slice(i, j - i)
            if fold is not None:
                own = own.filter(pc.not_equal(b.column(fold).slice(i, j - i), 0))
            if len(own):
                yield b, i, j, Step(own)
            i = j


def contexts(ids: np.ndarray, lengths: np.ndarray, V: int) -> np.ndarray:
    v = np.empty_like(ids)
    v[1:] = ids[:-1]
    v[np.cumsum(lengths) - lengths] = V
    return v


def train(docs: DataFrame, *, text: str = "text", fold: str = "fold") -> dict:
    """Writes the trie of the rows whose ``fold`` is not 0 and returns its description, which is small."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    spark.createDataFrame([], "x int").write.json(folder)  # makes the folder wherever it is
    n = pieces(docs, text, SHARD_BYTES, 8)
    model = {"folder": folder, "n1": n, "n2": n}
    rows = docs.select(text, fold)
    first = FAN ** (levels(n) - 1)  # shards in a group that a block addresses

    def count_words(batches):
        for _, _, _, step in steps(batches, 0, 1):
            many = np.bincount(step.codes, minlength=len(step.hashes))
            own = Counts.of_words(step.hashes[many > 0], many[many > 0])
            yield own.rows(shard_of_hash(own.keys, n) // first)

    def build_words(batches):
        done = {"shard": [], "n": [], "total": [], "docs": []}
        for own, rows_of in shards(batches):
            c = Counts.merged(rows_of, 0)
            put(folder, f"words-{own}", to_bytes({**EliasFano.build(c.keys, 1 << 64).arrays("hash"), "count": c.counts}))
            end = c.counts[c.keys == np.uint64(END_HASH)]
            for k, x in zip(done, (own, len(c.keys), int(c.counts.sum()), int(end.sum()))):
                done[k].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(done["shard"], pa.int32()), *(pa.array(done[k], pa.int64()) for k in ("n", "total", "docs"))], list(done))

    dealt = by_shard(rows.mapInArrow(lambda b: given_back(count_words(b)), BLOCK), n, lambda keys: shard_of_hash(keys, n), 0)
    got = dealt.sortWithinPartitions("shard").mapInArrow(lambda b: given_back(build_words(b)), "shard int, n long, total long, docs long").collect()
    got.sort()
    bases = np.cumsum([0] + [r["n"] for r in got])
    model |= {"words": [(r["shard"], int(b), r["n"]) for r, b in zip(got, bases)], "V": int(bases[-1]), "N": sum(r["total"] for r in got), "docs": sum(r["docs"] for r in got)}
    V = model["V"]
    bits = V.bit_length()  # an id of V, the beginning or no next word, fits too

    def shard_of(keys: np.ndarray, words: Words) -> np.ndarray:
        v, w = (keys // np.uint64(V)).astype(np.int64), (keys % np.uint64(V)).astype(np.int64)
        return shard_of_pair(v, w, context_counts(words, v), model)

    def count_triples(batches):
        words = Words(model)
        for _, _, _, step in steps(batches, 0, 1):
            ids, lengths = words.find(step.hashes)[0][step.codes], step.lengths
            after = np.append(ids[1:], V)
            after[np.cumsum(lengths) - 1] = V
            c = Counts.of_triples(contexts(ids, lengths, V).astype(np.uint64) * np.uint64(V) + ids.astype(np.uint64), after, np.ones(len(ids), np.int64), bits)
            yield c.rows(shard_of(c.keys, words) // first)

    def build_level(batches):
        words = Words(model)
        for own, rows_of in shards(batches):
            put(folder, f"trie-{own}", to_bytes(levels_of(Counts.merged(rows_of, bits), words, model)))
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32())], ["shard"])

    if V:
        found: list[Words] = []

        def dealt_by(keys: np.ndarray) -> np.ndarray:  # in a task: the words are mapped once
            if not found:
                found.append(Words(model))
            return shard_of(keys, found[0])

        dealt = by_shard(rows.mapInArrow(lambda b: given_back(count_triples(b)), BLOCK), n, dealt_by, bits)
        built = dealt.sortWithinPartitions("shard").mapInArrow(lambda b: given_back(build_level(b)), "shard int").collect()
        model["pairs"] = sorted(r["shard"] for r in built)
    else:
        model["pairs"] = []
    return model


def shards(batches):
    """(shard, its packed rows) of rows sorted by shard."""
    last, have = None, []
    for b in batches:
        for s, *r in zip(b.column(0).to_pylist(), *(map(pa.BinaryScalar.as_buffer, c) for c in b.columns[1:])):  # views, not copies
            if s != last and have:
                yield last, have
                have = []
            last = s
            have.append(r)
    if have:
        yield last, have


def levels_of(c: Counts, words: Words, model: dict) -> dict[str, np.ndarray]:
    """A shard's part of levels 2 and 3."""
    V = model["V"]
    v, w = (c.keys // np.uint64(V)).astype(np.int64), (c.keys % np.uint64(V)).astype(np.int64)
    own = np.repeat(np.arange(len(v)), c.many)
    total = np.add.reduceat(c.counts, np.cumsum(c.many) - c.many)
    ctx, rank = runs(v)
    real = c.after < V
    many = np.bincount(own[real], minlength=len(v))
    share = c.counts - DISCOUNT
    share /= total[own]
    value3 = quantised(share[real])
    del own, share
    return {
        **EliasFano.build(ctx, V + 1).arrays("context"),
        **EliasFano.build(np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(ctx)))]), len(v) + 1, ones=True).arrays("pointer"),
        **Ids.build(w, V).arrays("follower"),
        "value": quantised((total - DISCOUNT) / words.counts(ctx)[rank]),
        "mass": quantised(DISCOUNT * many / total),
        **EliasFano.build(np.concatenate([[0], np.cumsum(many)]), int(many.sum()) + 1, ones=True).arrays("pointer3"),
        **Ids.build(c.after[real], V).arrays("next"),
        "value3": value3,
    }


def quantised(p: np.ndarray) -> np.ndarray:
    x = np.maximum(p, 10.0**LEAST_LOG)
    np.log10(x, out=x)
    x /= LEAST_LOG
    x *= LEVELS - 1
    return np.round(x, out=x).astype(np.uint16)


#: The probability of each quantised value; the last one stands for none.
VALUES = np.append(10.0 ** (np.arange(LEVELS - 1) * LEAST_LOG / (LEVELS - 1)), 0.0)


def context_counts(words: Words, v: np.ndarray) -> np.ndarray:
    """``v`` is sorted: each context is looked up once."""
    own, back = runs(v)
    return words.counts(own)[back]


def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where each element's is among them."""
    new = first_of_runs(v)
    return v[new], np.cumsum(new) - 1


class Trie:
    """Queries of all levels."""

    def __init__(self, model: dict):
        self.model, self.words, self.shards = model, Words(model), {}
        self.there = set(model["pairs"])
        self.wide: dict[int, int] = {}  # distinct followers of contexts in several shards

    def shard(self, k: int) -> dict:
        if k not in self.shards:
            a = from_buffer(mapped(self.model["folder"], f"trie-{k}"))
            self.shards[k] = {
                "context": EliasFano.of(a, "context"),
                "pointer": EliasFano.of(a, "pointer"),
                "follower": Ids.of(a, "follower"),
                "pointer3": EliasFano.of(a, "pointer3"),
                "next": Ids.of(a, "next"),
                "value": a["value"],
                "mass": a["mass"],
                "value3": a["value3"],
            }
        return self.shards[k]

    def followers_of_wide(self, v: int, parts: int) -> int:
        if v not in self.wide:
            n, first, total = self.model["n2"], int(shard_of_context(np.array([v]), self.model["n2"])[0]), 0
            for k in {(first + i) % n for i in range(parts)} & self.there:
                s = self.shard(k)
                rank = s["context"].locate(np.array([v]))
                if rank[0] >= 0:
                    lo, hi = s["pointer"].ranges(rank)
                    total += int(hi[0] - lo[0])
            self.wide[v] = total
        return self.wide[v]

    def pairs(self, v: np.ndarray, w: np.ndarray, cv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted pairs of known words: shard, place in level 2 (-1 if unseen), discounted probability, mass of the context v."""
        shard, place = shard_of_pair(v, w, cv, self.model), np.full(len(v), -1, np.int64)
        p, many = np.zeros(len(v)), np.zeros(len(v))
        for k, at in of_each(shard):
            if k not in self.there:
                continue
            s = self.shard(k)
            own, back = runs(v[at])  # pairs come sorted, and a stable sort by shard keeps that
            rank = s["context"].locate(own)
            seen = rank >= 0
            lo, hi = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            lo[seen], hi[seen] = s["pointer"].ranges(rank[seen])
            many[at] = (hi - lo)[back]
            child = s["follower"].find(lo[back], hi[back], w[at])
            hit = child >= 0
            place[at[hit]], p[at[hit]] = child[hit], VALUES[s["value"][child[hit]]]
        parts = parts_of_context(cv, self.model)
        for i in np.flatnonzero(first_of_runs(v) & (parts > 1)):
            many[i : np.searchsorted(v, v[i], "right")] = self.followers_of_wide(int(v[i]), int(parts[i]))
        return shard, place, p, DISCOUNT * many / np.maximum(cv, 1)

    def triples(self, shard: np.ndarray, place: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted pairs found in level 2 and the words after them: discounted probability, mass of the pair."""
        p, mass = np.zeros(len(w)), np.ones(len(w))
        for k, at in of_each(shard):
            s = self.shard(k)
            own, back = runs(place[at])  # they come sorted, each pair as often as it occurs
            mass[at] = VALUES[s["mass"][own]][back]
            real = w[at] >= 0
            at, back = at[real], back[real]
            lo, hi = s["pointer3"].ranges(own)
            child = s["next"].find(lo[back], hi[back], w[at])
            hit = child >= 0
            p[at[hit]] = VALUES[s["value3"][child[hit]]]
        return p, mass

    def followers(self, k: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ids after context ``v`` in shard ``k`` and their discounted probabilities."""
        s = self.shard(k)
        rank = s["context"].locate(np.array([v]))
        if rank[0] < 0:
            return np.zeros(0, np.int64), np.zeros(0)
        lo, hi = s["pointer"].ranges(rank)
        return s["follower"].get(np.arange(lo[0], hi[0])).astype(np.int64), VALUES[s["value"][lo[0] : hi[0]]]

    def score(self, ids: np.ndarray, counts: np.ndarray, alone: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each token of the texts that ``ids`` holds one after another; ``alone`` is each word's own probability, and is overwritten."""
        V = self.model["V"]
        v = contexts(ids, lengths, V)
        cv = np.append(self.model["docs"], counts[:-1])
        cv[v == V] = self.model["docs"]
        p = alone
        known = np.flatnonzero((v >= 0) & (cv > 0))
        if not len(known) or not V:
            return np.log10(p)
        w = ids[known]
        keys = v[known].astype(np.uint64) * np.uint64(V + 1) + np.where(w < 0, V, w).astype(np.uint64)  # V: unknown word
        order = np.argsort(keys)
        new = first_of_runs(keys[order])
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        one = known[order[new]]
        real = ids[one] >= 0
        shard, place, f, mass = self.pairs(v[one], np.where(real, ids[one], 0), cv[one])
        f, place = np.where(real, f, 0), np.where(real, place, -1)
        p[known] = f[back] + mass[back] * p[known]
        # The pair that ends before a token is its longer context.
        at = np.full(len(ids), -1, np.int64)
        at[known] = back
        pair = np.append(-1, at[:-1])
        pair[v == V] = -1
        deep = np.flatnonzero(pair >= 0)
        deep = deep[place[pair[deep]] >= 0]
        deep = deep[np.argsort(pair[deep])]
        f, mass = self.triples(shard[pair[deep]], place[pair[deep]], ids[deep])
        p[deep] = f + mass * p[deep]
        return np.log10(p)


def of_each(shard: np.ndarray):
    """(shard, places of its elements in order)."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65_536 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(shard[order[i]]), order[i:j]


SCORES = T.StructType([*(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score(docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``docs`` with token counts and the base's and the model's log10 probability of each whole text."""
    rest = [c for c in docs.columns if c not in SCORES.names]
    out = [c for c in rest if c != text]
    schema = T.StructType([*docs.select(*out).schema.fields, *SCORES.fields])

    def run(batches):
        trie = Trie(model)
        for b, i, j, step in steps(batches, len(out), most=SCORED):
            found, seen = trie.words.find(step.hashes)
            alone = trie.words.p(seen)
            ids, counts, base, lengths = found[step.codes], seen[step.codes], np.log10(alone)[step.codes], step.lengths
            starts = np.cumsum(lengths) - lengths
            each = lambda x: np.add.reduceat(x, starts)
            cols = [lengths, each((counts > 0).astype(np.int64)), np.full(len(lengths), model["N"]), each(base), each(trie.score(ids, counts, alone[step.codes], lengths))]
            yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns[:-1], *(pa.array(x, pa.int64()) for x in cols[:3]), *(pa.array(x, pa.float64()) for x in cols[3:])], schema.names)

    return docs.select(*out, text).mapInArrow(lambda batches: given_back(run(batches)), schema)


def train_and_score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Trains on the rows whose crc32(doc_id) modulo ``FOLDS`` is not 0 and scores all rows."""
    own = docs.select("doc_id", "text", crc_mod(F.col("doc_id"), FOLDS).cast("int").alias("fold"))
    model = train(own)
    return score(own, model).select("doc_id", (F.col("fold") == 0).alias("held_out"), *SCORES.names)
