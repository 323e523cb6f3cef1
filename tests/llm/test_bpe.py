import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_agrees_with_the_library(library):
    random.seed(3)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "\x85", "\xa0", "　", " ", "é", "ß", "日本", "😀", "1", "23", "'s", "'ll", "'", ".", "!!!", "\x1c", "​", "x" * 30, "ab" * 80, "İ", "_", "<|endoftext|>"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(800)]
    texts += ["", " ", "a" * 5000, " " * 3000, "abc" * 2000, "\n" * 999 + "x", "word " * 3000]
    tok = bpe.Tokenizer(PATH, PATTERN)
    for t, ids in zip(texts, tok.encode_batch(texts)):
        assert ids.tolist() == library.encode_ordinary(t)
        assert tok.decode(ids) == t.encode()


def test_lookup_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 300)
    tok = bpe.Tokenizer(PATH, PATTERN)
    for _ in range(3):
        for t in ("one two three four", "five six seven eight"):
            assert tok.encode_batch([t])[0].tolist() == library.encode_ordinary(t)


def test_long_pieces(library):
    rng = random.Random(5)
    tok = bpe.Tokenizer(PATH, PATTERN)
    pieces = ["".join(rng.choices("abcdehinorst", k=n)) for n in (97, 128, 129, 500, 511, 512, 4000, 30_000)] + ["a" * 1001, "日本語" * 700, "ab" * 4001 + "c", "aab" * 333]
    for p, ids in zip(pieces, tok.merge([p.encode() for p in pieces])):
        assert ids.tolist() == library.encode_ordinary(p)


def test_spark_round_trip(spark, library):
    texts = [None, "", "hello world", "hello world", " \n x", "é" * 500, "a b " * 5000]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_chars int")
    rows = {r.doc_id: r for r in bpe.digests(bpe.round_trip(docs, PATH, PATTERN)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].n_chars == i
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
