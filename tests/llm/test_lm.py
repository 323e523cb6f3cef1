import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import lm
from plumbline.llm.elias_fano import EliasFano, from_buffer, to_bytes


@pytest.mark.parametrize("n,universe", [(0, 10), (1, 1), (5, 100), (1000, 2000), (1000, 1000), (5000, 2**63), (300, 70_000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n)).astype(np.uint64)
    if n == 300:
        v = np.unique(np.concatenate([np.arange(300), [69_999]])).astype(np.uint64)
    seq = EliasFano.of(from_buffer(to_bytes(EliasFano.build(v, universe).arrays("x"))), "x")
    asked = np.concatenate([v, rng.integers(0, universe, 500).astype(np.uint64)])
    at = {int(x): i for i, x in enumerate(v)}
    assert seq.locate(asked).tolist() == [at.get(int(x), -1) for x in asked]
    if len(v):
        seq = EliasFano.of(from_buffer(to_bytes(EliasFano.build(v, universe, ones=True).arrays("x"))), "x")
        assert (seq.get(np.arange(len(v))) == v).all()
        lo, hi = seq.ranges(np.arange(len(v) - 1))
        assert (lo == v[:-1].astype(np.int64)).all() and (hi == v[1:].astype(np.int64)).all()


def check(rows, got):
    tok = [lm.tokens(t) for _, t in rows]
    train = [i for i, (d, _) in enumerate(rows) if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = collections.Counter(w for i in train for w in tok[i])
    N, V = sum(c.values()), len(c)
    c2 = collections.Counter(p for i in train for p in zip([None, *tok[i]], tok[i]))
    c3 = collections.Counter(p for i in train for p in zip([None, *tok[i]], tok[i], tok[i][1:]))
    n2, n3 = collections.Counter(a for a, _ in c2), collections.Counter((a, b) for a, b, _ in c3)
    before = lambda v: len(train) if v is None else c[v]
    D = lm.DISCOUNT

    def p1(w):
        return (c[w] + 0.1) / (N + 0.1 * (V + 1))

    def p2(a, b):
        return max(c2[a, b] - D, 0) / before(a) + D * n2[a] / before(a) * p1(b) if before(a) else p1(b)

    def p3(u, a, b):
        return max(c3[u, a, b] - D, 0) / c2[u, a] + D * n3[u, a] / c2[u, a] * p2(a, b) if c2[u, a] else p2(a, b)

    want = {}
    for i, ((d, _), ws) in enumerate(zip(rows, tok)):
        score = sum(math.log10(p2(None, b) if j == 0 else p3(ws[j - 2] if j > 1 else None, ws[j - 1], b)) for j, b in enumerate(ws))
        fold = zlib.crc32(("" if d is None else str(d)).encode()) % 10
        want.setdefault((d, fold == 0, len(ws), sum(c[w] > 0 for w in ws), N), []).append((sum(math.log10(p1(w)) for w in ws), score))
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), []).append((r.base_score, r.score))
    assert have.keys() == want.keys()
    for k, own in want.items():
        for (b, s), (b2, s2) in zip(sorted(own), sorted(have[k]), strict=True):
            assert abs(b - b2) < 1e-6 * k[2] and abs(s - s2) < 1.5e-4 * k[2]  # a value is off by half a level of 16 / 65,535 at most
    return sum(b for v in want.values() for b, _ in v), sum(s for v in want.values() for _, s in v)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[min(59, int(rng.exponential(8)))] for _ in range(rng.integers(0, 50)))) for i in range(200)]
    rows += [(None, "w1 W1\tw2"), (7, None), (11, ""), (12, " \n "), (12, " \n "), (13, "hot " * 3000), (30, "unseen words é only here")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, source string")
    base, score = check(rows, lm.train_and_score(spark, docs.repartition(3)).collect())
    assert score > base


@pytest.mark.parametrize("n", [1, 37])
def test_shards_dealt_out_in_levels(spark, monkeypatch, n):
    """Any number of shards and any fan-out give the same scores."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{min(200, int(rng.exponential(20)))}" for _ in range(rng.integers(0, 40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "pieces", lambda *_: n)
    monkeypatch.setattr(lm, "FAN", 3)
    assert lm.levels(37) == 4
    check(rows, lm.train_and_score(spark, docs.repartition(3)).collect())


def test_building_twice_gives_the_same_files(tmp_path):
    raw = [b"one", b"two"]
    for x in raw:
        lm.put(f"file://{tmp_path}", "a", x)
    assert bytes(lm.mapped(f"file://{tmp_path}", "a")) == b"one" and [f.name for f in tmp_path.iterdir()] == ["a"]


def test_triples():
    rng = np.random.default_rng(7)
    k, x = rng.integers(0, 50, 4000).astype(np.uint64), rng.integers(0, 9, 4000)
    want = collections.Counter(zip(k.tolist(), x.tolist()))
    rows = []
    for part in np.array_split(np.arange(4000), 5):
        b = lm.Counts.of_triples(k[part], x[part], np.ones(len(part), np.int64), 4).rows((k[part] * 0).astype(np.int64)[: len(np.unique(k[part]))])
        rows += [tuple(r.values())[1:] for r in b.to_pylist()]
    c = lm.Counts.merged(rows, 4)
    assert collections.Counter(dict(zip(zip(np.repeat(c.keys, c.many).tolist(), c.after.tolist()), c.counts.tolist()))) == want


def test_empty_and_untrained(spark):
    assert lm.train_and_score(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.train_and_score(spark, spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b a c a d b a") for i in range(1, 9)], "doc_id long, text string").selectExpr("*", "1 AS fold")
    model = lm.train(docs)
    trie = lm.Trie(model)
    words = [b"a", b"b", b"c", b"d", lm.END]
    ids, counts = trie.words.find(np.array([lm.word_hash(w) for w in words], np.uint64))
    found = [trie.followers(k, int(ids[0])) for k in model["pairs"]]
    assert sum(len(w) for w, _ in found) == 4  # b, c, d and the end
    base, unknown = trie.words.p(counts), trie.words.p(np.zeros(1))
    for head in ([], [0], [1, 0], [2, 3], [3, 3]):  # contexts: the beginning, seen and unseen pairs
        total = 0.0
        for last in range(6):
            seq = [*head, last]
            own = np.array([ids[i] if i < 5 else -1 for i in seq]), np.array([counts[i] if i < 5 else 0 for i in seq]), np.array([base[i] if i < 5 else unknown[0] for i in seq])
            total += 10 ** trie.score(*own, np.array([len(seq)]))[-1]
        assert abs(total - 1) < 1e-3


def test_hashes_of_words():
    words = [b"", b"a", b"b", b"ab", b"a\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * 64, b"x" * 65, b"y" * 1000, "é".encode()] + [f"w{i}".encode() for i in range(5000)]
    whole = lm.hashes_of(pa.array(words, pa.binary()))
    assert len(set(whole.tolist())) == len(words)
    assert [lm.word_hash(w) for w in words[:12]] == whole[:12].tolist()  # whatever stands beside a word
    assert lm.hashes_of(pa.array(words, pa.binary()).slice(3, 5)).tolist() == whole[3:8].tolist()
    assert np.unique(lm.shard_of_hash(whole, 16)).size == 16


def test_steps_read_words_as_the_tokens_do():
    texts = ["  A\tb \n b\x0b", "", None, "É\x85x\xa0y \x1c z", " ", "one " * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    got = [s for *_, s in lm.steps([batch], 0)]
    hashes = [h for s in got for h in s.hashes[s.codes].tolist()]
    assert hashes == [lm.word_hash(w) for t in texts for w in lm.tokens(t)]
    assert [n for s in got for n in s.lengths.tolist()] == [len(lm.tokens(t)) for t in texts]


def test_few_groups_are_dealt_to_all_partitions(spark, tmp_path):
    """430 shards are two groups; the blocks of both are merged by all partitions, not by two."""
    n, folder = 430, str(tmp_path)
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2))
    blocks = [r for part in np.array_split(rng.permutation(keys), 400) for r in lm.Counts.of_words(part, np.ones(len(part), np.int64)).rows(np.zeros(len(part), np.int64)).to_pylist()]
    blocks = [{**r, "shard": i % 2} for i, r in enumerate(blocks)]

    def shard_of(own):
        from pyspark import TaskContext

        open(f"{folder}/{TaskContext.get().partitionId()}", "w").close()
        return lm.shard_of_hash(own, n)

    rows = lm.by_shard(spark.createDataFrame(blocks, lm.BLOCK), n, shard_of, 0).select("keys").collect()
    assert sorted(k for r in rows for k in np.cumsum(lm.unplanes(r["keys"], np.uint64), dtype=np.uint64).tolist()) == keys.tolist()
    assert len(list(tmp_path.iterdir())) > 40


def test_a_pair_is_looked_up_once_in_a_step(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b a c a d b a") for i in range(1, 9)], "doc_id long, text string").selectExpr("*", "1 AS fold")
    trie, asked = lm.Trie(lm.train(docs)), []
    step = lm.Step(pa.array(["a b a c a d b a"] * 50))
    for k in trie.model["pairs"]:
        p = trie.shard(k)["pointer3"]
        monkeypatch.setattr(p, "ranges", lambda i, f=p.ranges: asked.append(len(i)) or f(i))
    found, seen = trie.words.find(step.hashes)
    trie.score(found[step.codes], seen[step.codes], trie.words.p(seen)[step.codes], step.lengths)
    assert 0 < sum(asked) <= 9  # the distinct pairs, not the 400 places after them
