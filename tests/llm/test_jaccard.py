import itertools
import random

import pytest

from plumbline.llm import jaccard


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset([tuple(ws)] if 0 < len(ws) < 5 else (tuple(ws[i : i + 5]) for i in range(len(ws) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
            up[find(j)] = find(i)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def words(rng, n, kinds=400):
    return [f"w{rng.randint(0, kinds)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for i in range(60):
        ws = words(rng, rng.randint(1, 120))
        rows.append((len(rows), " ".join(ws)))
        for _ in range(rng.choice([0, 0, 1, 4])):  # near copies, some of them of one another
            k = rng.randint(0, max(0, len(ws) - 1))
            ws = [*ws[:k], f"n{rng.random()}", *ws[k + 1 :]]
            rows.append((len(rows), " ".join(ws)))
    rows += [(len(rows) + i, " ".join([*words(rng, 80), *passage, *words(rng, 80)])) for i in range(15)]
    rows += [(1000 + i, rows[0][1].upper()) for i in range(60)]
    base = words(rng, 100, 10**6)
    for i in range(80):  # a large group of near copies
        k = rng.randint(0, 95)
        rows.append((2000 + i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])))
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, ""), (3004, "a b"), (3005, "A  b"), (3006, "b a"), (None, rows[0][1]), (None, "only null ids"), (None, "only null ids"), (3007, "z " * 5000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, key int")
    got = jaccard.join(docs.repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_common_shingles_stay_in_their_block(spark, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 60, 10**6)
    rows = [(i, " ".join([*base[: 30 + i % 3], f"y{i % 40}", *base[31 + i % 3 :]])) for i in range(150)]
    monkeypatch.setattr(jaccard, "HOT", 4)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_one_of_each_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(50))
    docs = spark.createDataFrame([(4, text, "a"), (2, text + " end", "b"), (2, text + " end", "b"), (9, "other words here", "c"), (10, None, "d"), (None, text, "e")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.source) for r in jaccard.one_of_each(docs).collect()) == [(2, "b"), (9, "c"), (10, "d")]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_links_inside_components_count(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 100, 10**6)
    rows = []
    for i in range(70):  # near copies, all linked, and chains in which only neighbours link
        k = rng.randint(0, 95)
        rows.append((i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])))
    for c in range(12):
        ws = words(rng, 80, 10**6)
        for i in range(1 + c % 6):
            ws = [*ws[:-7], *(f"c{c}-{i}-{k}" for k in range(7))] if i % 2 else [*(f"d{c}-{i}-{k}" for k in range(7)), *ws[7:]]
            rows.append((100 + 10 * c + i, " ".join(ws)))
    rows += [(300, rows[0][1].upper()), (301, None), (302, "alone")]
    sets = {d: shingles(t) for d, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {d: sum(near(s, o) for o in set(sets.values()) - {s, frozenset()}) for d, s in sets.items()}
    assert want[0] > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "BLOCK", 32)  # one component has several blocks, the others one
    assert {r.doc_id: r.n_links for r in jaccard.join(docs).collect()} == want


def test_group_that_links_with_itself_but_not_with_its_pivot(spark, monkeypatch):
    rng = random.Random(11)
    passage, base = words(rng, 60, 10**6), words(rng, 90, 10**6)
    rows = [(i, " ".join([*passage, *words(rng, 6, 10**6)])) for i in range(3)]  # fewest shingles of their own: the passage's pivots
    for i in range(60):
        k = rng.randint(2, 85)
        rows.append((100 + i, " ".join([*passage, *base[:k], f"x{i}", *base[k + 1 :]])))
    monkeypatch.setattr(jaccard, "SMALL", 8)
    listed = []
    sharing = jaccard.sharing
    monkeypatch.setattr(jaccard, "sharing", lambda far: listed.append(sharing(far)) or listed[-1])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert listed[0].count() < 3 * len(rows)  # not the square of the group


def test_parts_of_one_text_that_overlap_too_little_to_link(spark, monkeypatch):
    rng = random.Random(3)
    pieces = [words(rng, 12, 10**6) for _ in range(12)]
    rows = [(0, " ".join(w for p in pieces for w in p))]
    for i in range(90):
        kept = sorted(rng.sample(range(12), 6))
        rows.append((100 + 2 * i, " ".join(w for k in kept for w in pieces[k])))
        if i % 3 == 0:  # a near copy
            rows.append((101 + 2 * i, " ".join([*(w for k in kept for w in pieces[k]), f"x{i}"])))
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    listed = []
    sharing = jaccard.sharing
    monkeypatch.setattr(jaccard, "sharing", lambda posts: listed.append(sharing(posts)) or listed[-1])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert len({r.component_id for r in got}) > 20
    assert listed[0].count() < 20 * len(rows)  # not the square of the group
