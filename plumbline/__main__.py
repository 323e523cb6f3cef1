"""python -m plumbline RUNS_PATH [AS_OF]: diagnoses JSON runs and prints one JSON line a run."""

from __future__ import annotations

import sys
from datetime import date

from pyspark.sql import SparkSession

from plumbline.plans.diagnose import diagnose
from plumbline.sources.runs import read_runs


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for line in diagnose(read_runs(spark, args[0]), as_of=args[1] if len(args) > 1 else str(date.today())).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
