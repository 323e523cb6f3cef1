"""Small named things on the driver: curated cases, parser profiles, calibrations, and providers of signals."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk columns under the names that other frameworks give them (fixed names).
ALIASES = {
    "chunk_id": ("chunk_id", "id", "node_id"),
    "text": ("text", "page_content", "content", "body"),
    "source_doc_id": ("source_doc_id", "doc_id", "document_id", "source"),
    "score": ("score", "similarity", "relevance_score"),
}


def cases(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The curated cases of a folder of JSON files, or the one of a name; the rest is not kept."""
    rows = spark.read.option("mode", "FAILFAST").json(folder, multiLine=True)
    return rows if name is None else rows.where(F.col("case_id") == name)


def chunks(rows: DataFrame) -> DataFrame:
    """Rows of any framework as chunks: each column from the first alias that is there; columns that are nowhere are null."""
    low = {c.lower(): c for c in rows.columns}
    pick = lambda names: F.coalesce(*(F.col(f"`{low[n]}`").cast("string") for n in names if n in low), F.lit(None).cast("string"))
    return rows.select(*((pick(names).cast("double") if to == "score" else pick(names)).alias(to) for to, names in ALIASES.items()))


def calibration(spark: SparkSession, path: str) -> dict:
    """A calibration (mode, params) from a JSON file; one that is missing or broken calibrates nothing."""
    try:
        raw = "\n".join(r.value for r in spark.read.text(path).collect())  # a settings file
        found = json.loads(raw)
    except Exception as e:  # a bad file must not end a diagnosis
        return {"mode": "none", "params": {}, "warning": str(e).splitlines()[0]}
    return {"mode": found.get("mode", "none"), "params": found.get("params", {})} if isinstance(found, dict) else {"mode": "none", "params": {}, "warning": "no object"}


def profile(text: str) -> dict:
    """A parser profile from JSON text, or from lines "key: value" with "- item" lists and one level of indented keys."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    at: str | None = None
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare.strip():
            continue
        inner, body = bare[0] in " \t", bare.strip()
        if body.startswith("- ") and at is not None:
            if not isinstance(out[at], list):
                out[at] = []
            out[at].append(plain(body[2:]))
        else:
            key, _, value = body.partition(":")
            if inner and at is not None:
                if not isinstance(out[at], dict):
                    out[at] = {}
                out[at][key.strip()] = plain(value)
            else:
                at = key.strip()
                out[at] = plain(value) if value.strip() else {}
    return out


def profile_text(found: dict) -> str:
    """A profile as the text that ``profile`` reads."""
    show = lambda v: json.dumps(v) if isinstance(v, bool | list) else str(v)
    lines = []
    for key, value in found.items():
        if isinstance(value, dict):
            lines += [f"{key}:", *(f"  {k}: {show(v)}" for k, v in value.items())]
        elif isinstance(value, list):
            lines += [f"{key}:", *(f"  - {v}" for v in value)]
        else:
            lines.append(f"{key}: {show(value)}")
    return "\n".join(lines) + "\n"


def plain(text: str):
    """A scalar: JSON where it is that, else the text."""
    try:
        return json.loads(text.strip())
    except ValueError:
        return text.strip().strip("\"'")


@dataclass
class Providers:
    """Who can give signals about runs: a name, what it needs, and a function from runs to a signal table (run_id, provider, metric, value)."""

    known: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, signals: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] = ()) -> None:
        if name in self.known:
            raise ValueError(f"{name} is there already")
        self.known[name] = (signals, needs)

    def ready(self) -> dict[str, str]:
        """Each provider's state: ready, or what it lacks."""
        import importlib.util

        lacks = {n: [m for m in needs if importlib.util.find_spec(m) is None] for n, (_, needs) in self.known.items()}
        return {n: "ready" if not x else f"lacks {', '.join(x)}" for n, x in lacks.items()}

    def signals(self, runs: DataFrame) -> DataFrame:
        """The signals of all providers that are ready, in one table; empty without any."""
        out = runs.sparkSession.createDataFrame([], "run_id string, provider string, metric string, value double")
        for name, state in self.ready().items():
            if state == "ready":
                out = out.unionByName(self.known[name][0](runs).select("run_id", F.lit(name).alias("provider"), "metric", F.col("value").cast("double").alias("value")))
        return out
