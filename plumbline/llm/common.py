"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the characters 9 to 13. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; where it is unset, a folder of our own on one machine and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, text: str, each: int, least: int) -> int:
    """How many parts of about ``each`` bytes of text the input makes, ``least`` at least; a pass over the texts' lengths."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, math.ceil(total / each))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(*columns: str) -> Column:
    """128 bits of a row's columns, which tell rows apart; null differs from empty."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\n", *map(part, columns)).cast("binary")))


def slices(batches, rows: int = 2000):
    """Batches of ``rows`` rows at most, so that a task holds few texts at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def trimmed(build):
    """``build`` of a group's table, with the memory it took given back."""

    def run(table):
        out = build(table)
        trim()
        return out

    return run


def given_back(rows):
    """Yields ``rows`` and then returns the memory that the task's tables held to the system, as a worker outlives its task and waits beside the next one's."""
    try:
        yield from rows
    finally:
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
