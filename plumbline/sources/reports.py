"""Small reports of collected metrics as JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def rows_of(metrics: DataFrame, most: int = 1000) -> list[dict]:
    """A metric table on the driver; it is an aggregate, and ``most`` guards against anything else."""
    rows = [r.asDict(recursive=True) for r in metrics.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report holds {most} rows at most")
    return rows


def markdown(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    head = list(rows[0])
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join(str(r[k]) for k in head) + " |" for r in rows)]) + "\n"


def as_json(title: str, rows: list[dict]) -> str:
    return json.dumps({"title": title, "rows": rows}, indent=1, default=str)
