"""Each query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def norm(v):
    if v is None or v is pd.NA or v != v:
        return "null"
    if isinstance(v, (bool, float)) or hasattr(v, "__index__"):
        return f"{float(v) + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(norm, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_confidence_sums_in_file_order(spark, tmp_path):
    """A mean of 0.5 is under the penalty's limit or not by the order of its sum; files and splits must not change that."""
    import datetime
    import itertools
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, keys = random.Random(3), range(400)
    rows = list(itertools.chain(*([(k, d / 100) for k, d in zip(keys, ds)] for ds in zip(*[(a, b, c, 20 - a - b - c) for a, b, c in ([rng.randint(0, 6) for _ in range(3)] for _ in keys)]))))
    table = pa.table({"l_orderkey": pa.array([k for k, _ in rows], pa.int64()), "l_discount": [d for _, d in rows], "l_returnflag": ["N"] * len(rows), **{c: [0] * len(rows) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")}, "l_shipdate": [datetime.date(2000, 1, 1)] * len(rows)})
    (tmp_path / "lineitem.parquet").mkdir()
    for i in range(8):
        pq.write_table(table.slice(i * 200, 200), tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    want = {}
    for k, d in rows:
        want[k] = want.get(k, 0.0) + d * 10
    want = {k: round(s / 4 - (0.1 if s / 4 < 0.5 else 0), 6) for k, s in want.items()}
    got = {r.run_id: r.confidence for r in catalogue.QUERIES["confidence_score"](spark, str(tmp_path)).collect()}
    assert set(want.values()) == {0.4, 0.5} and got == want
