import collections
import hashlib
import string

import pytest
from pyspark.sql import functions as F

from plumbline.llm import naming

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, keep_id string, name int"


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOW)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept |= i == keep
    return sorted(out, key=str)


ROWS = (
    [(i, f"Copy of ONE text, {'long ' * 40}É", "x", i) for i in range(60)]
    + [(100 + i, f"copy of one text, {'LONG ' * 40}{'é' if i % 2 else 'É'}", "x", i) for i in range(6)]
    + [(200, "ab" * 50, "", 0), (201, "ab" * 49, "", 0), (202, "ab" * 49 + "a", "", 0), (203, "AB" * 50, "", 0), (203, "ab" * 50, "", 1)]
    + [(300, None, None, None), (301, "", "", 1), (302, " ", "", 1), (None, "", "", 1), (None, "only", "", 1), (None, "ONLY", "", 2), (303, "a\x00b", "", 0), (304, "a\x00B", "", 0)]
    + [(400, "x" * 5000, "", 1), (401, "x" * 4999, "", 1), (402, "x" * 4999 + "y", "", 1), (403, "X" * 5000, "", 1)]
)


@pytest.mark.parametrize("block,few", [(4, 1), (16, 8), (512, 256)])
def test_equal_texts_share_an_identity(spark, block, few):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = naming.dedup(df, block=block, few=few)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_names_stand_for_contents(spark):
    """Documents of different widths end at different levels; equal names at one level mean equal texts."""
    rows = [(i, t) for i, t in enumerate(["aaaa", "aaaabbbb", "bbbbaaaa", "aaaabbbbcccc", "aaaabbbb", "aaaabbbbccccdddd", "cccc", "aaaa"])]
    own = naming.identities(spark.createDataFrame(rows, "doc_id long, text string"), block=4, few=1).collect()
    ids = {r.doc_id: (r.level, r.name) for r in own}
    assert [ids[i][0] for i in range(8)] == [0, 1, 1, 2, 1, 2, 0, 0]
    texts = dict(rows)
    assert all((ids[i] == ids[j]) == (texts[i] == texts[j]) for i in ids for j in ids)


def test_empty_and_plain(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert naming.dedup(none).count() == 0
    one = naming.dedup(spark.createDataFrame([(7, "x", "", 0)], SCHEMA)).first()
    assert (one.doc_id, one.keep_id, one.group_size, one.kept) == (7, 7, 1, True)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    plan = naming.dedup(df.select("doc_id", F.upper("text").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
