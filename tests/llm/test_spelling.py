import collections
import random
import re
import string
import zlib

import pytest

from plumbline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def one_edit(w):
    """Every text one edit away, over the letters in use."""
    letters = string.ascii_lowercase + "".join(map(chr, range(0xC0, 0x100)))
    cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters} - {w}


def brute(rows, every=31, times=10):
    n = collections.Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: (one_edit(w) - {w}) & n.keys() if len(w) < 100 else set() for w in n}  # only one word is longer
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * c else None
    out = []
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def mangled(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abé÷ÿz") + w[i:], w[:i] + rng.choice("abé÷ÿz") + w[i + 1 :]])


def corpus(seed, docs=120, base=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aabcdeéß") for _ in range(rng.randint(6, 12))) for _ in range(base)] + ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ababababa", "ÀÿÀÿÀÿÀÿ"]
    odd = words + [mangled(rng, w) for w in words for _ in range(4)] + [mangled(rng, mangled(rng, w)) for w in words]
    rows = []
    for i in range(docs):
        some = [rng.choice(words[: 1 + i % 46]) if rng.random() < 0.8 else rng.choice(odd) for _ in range(60)]
        rows.append((i if i % 9 else None, "".join(x + rng.choice([" ", "-", "1", ".\n"]) for x in some).replace("a", "A", 3), "clash", i))
    return rows + [(500, None, "", 0), (501, "", "", 0), (502, "short words only", "", 0), (503, "ŒŒŒŒŒŒŒŒ ĀĀĀĀĀĀĀĀ", "", 0), (504, "longwordlongword" * 3000 + " x " + "longwordlongword" * 3000, "", 0)] + rows[:3] * 2


@pytest.mark.parametrize("seed,long", [(0, 4096), (1, 5)])
def test_equals_brute_force(spark, seed, long):
    rows = corpus(seed)
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(4), long=long)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert sum(w[1] is not None for w in want) > 20


def test_every_close_pair_shares_a_key(spark):
    """Words of few letters, where bigrams repeat: all pairs one edit apart are found, at any length of list."""
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(400)}
    vocab = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n int")
    want = {(a, b) for a in words for b in one_edit(a) & words if a < b}
    for long in (10_000, 20):
        pairs = spelling.near_pairs(vocab, long=long)
        assert sorted(map(tuple, pairs.collect())) == sorted(want)


def test_typos_follow_the_digest(spark):
    df = spark.createDataFrame([(i, "Straßenbahn", "", 0) for i in range(400)], SCHEMA)
    got = collections.Counter(r.word for r in spelling.words(df, doc_id="doc_id", text="text", every=31).collect())
    want = collections.Counter()
    for i in range(400):
        h = zlib.crc32(f"{i}:straßenbahn".encode())
        want["straßenbahn" if h % 31 else "straßenbahn"[: h % 11] + "straßenbahn"[h % 11 + 1 :]] += 1
    assert got == want and len(want) > 3


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", 0), (None, "seldom", "", 0)], SCHEMA)).count() == 0


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["abcdefgh"] * 300 + ["abcdefgx"] * 25 + ["abcdefxx"] * 2), "", 0)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), every=1 << 40).collect()}
    assert [(got[w].form, got[w].root, got[w].n_near) for w in ("abcdefgh", "abcdefgx", "abcdefxx")] == [(None, "abcdefgh", 1), ("abcdefgh", "abcdefgh", 2), ("abcdefgx", "abcdefgh", 1)]
