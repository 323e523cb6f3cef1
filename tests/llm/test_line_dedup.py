import random

from plumbline.llm import line_dedup as ld


def brute(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        lines, kept = ld.split_lines(t), []
        for i, j, counts in ld.chunk_spans(lines):
            chunk = b"\n".join(lines[i:j])
            if counts and chunk in seen:
                continue
            seen |= {chunk} if counts else set()
            kept += lines[i:j]
        out[d, t] = None if t is None else b"\n".join(kept).decode()
    return sorted(((d, out[d, t]) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_against_brute_force(spark):
    rng = random.Random(4)
    shared = ["\n".join(f"shared {k} line {i}" for i in range(9)) for k in range(3)]
    long_line = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(120):
        lines = [f"own {i} {rng.random()}" for _ in range(rng.randint(0, 8))]
        lines.insert(rng.randint(0, len(lines)), rng.choice([*shared, long_line, "", "menu", " \n \n "]))
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, None), (None, long_line), (301, ""), (302, "\n\n\n"), (5, rows[5][1]), (303, "x" * 200_000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_lines int")
    got = ld.dedup(docs.repartition(5)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) == brute(rows)
    assert all(r.n_lines == len(ld.split_lines(dict(rows)[r.doc_id])) for r in got if r.doc_id is not None)
    assert ld.dedup(docs.limit(0)).count() == 0


def test_boundaries_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    chunks = lambda x: {b"\n".join(x[i:j]) for i, j, _ in ld.chunk_spans(x)}
    a, b = chunks(lines), chunks([b"new", *lines[:100], b"other", *lines[100:]])
    assert len(a & b) > 0.9 * len(a)


def test_a_long_line_is_a_chunk():
    long_line = b" ".join(b"w%d" % i for i in range(50))
    assert (1, 2, True) in ld.chunk_spans([b"a", long_line, b"b"])
    assert ld.chunk_spans([b"a"]) == [(0, 1, False)] and ld.chunk_spans([]) == []


def test_short_lines_of_a_repeated_passage_go_whole(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"v{rng.random()}" for _ in range(n))
    passages = [[fresh(60 // k) for _ in range(k)] for k in (2, 3, 4)] + [[fresh(20), "", fresh(30), fresh(9)], [fresh(5), fresh(70), fresh(3)]]
    rows, own = [], {}
    for i in range(60):
        before, after = ([fresh(4) for _ in range(rng.randint(1, 4))] for _ in range(2))
        rows.append((i, "\n".join([*before, *passages[i % 5], *after])))
        own[i] = "\n".join([*before, *(passages[i % 5] if i < 5 else []), *after])
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in got} == own
    assert all(r.removed_lines == (0 if r.doc_id < 5 else len(passages[r.doc_id % 5])) for r in got)


def test_runs_within_a_document(spark):
    passage = "\n".join(" ".join(f"q{k}-{i}" for i in range(20)) for k in range(3))
    rows = [(1, f"a\n{passage}\nb\n{passage}\nc"), (2, "\n".join(["menu"] * 70)), (3, "x\n" + " ".join(["short"] * 49) + "\ny"), (4, "z\n" + " ".join(["short"] * 49))]
    got = {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f"a\n{passage}\nb\nc" and got[3] == rows[2][1] and got[4] == rows[3][1]
    assert set(got[2].split("\n")) == {"menu"}


def test_windows_cover_every_run_of_enough_words():
    rng = random.Random(2)
    for _ in range(300):
        lines = [b" ".join([b"w"] * rng.choice([0, 1, 3, 10, 24, 49, 50, 70])) for _ in range(rng.randint(0, 12))]
        windows = ld.run_spans(lines)
        for i in range(len(lines)):
            for j in range(i + 2, len(lines) + 1):
                if lines[i] and lines[j - 1] and sum(len(x.split()) for x in lines[i:j]) >= 50:
                    inside = {k for a, b in windows if i <= a and b <= j for k in range(a, b)}
                    inside |= {k for k in range(i, j) if len(lines[k].split()) >= 50}
                    assert all(k in inside or not lines[k] for k in range(i, j))
