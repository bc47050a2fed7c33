"""``python -m vaksetu.plans.windows PROFILE.json...``: window costs of the declared source mix from profile files.

Exit code 0 with the tables, 1 if a profile belongs to no declared source, 2 without arguments.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import window_cost
from ..sources.manifests import read_profiles
from .render import render_windows


def main(spark: SparkSession, paths: list[str]) -> int:
    if not paths:
        print(__doc__, file=sys.stderr)
        return 2
    plan = spark.createDataFrame([(s.dataset, s.hours) for s in DEFAULT.corpus.sources], "source string, hours double")
    try:
        known, missing = window_cost.declared(read_profiles(spark, *paths), plan)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    table = window_cost.quantile_table(F.struct("duration_s", "clips_over_10s_pct"))
    rows = known.select("source", F.explode(window_cost.quantile_samples(table)).alias("duration_s"))
    hours = known.select("source", "hours")
    mix = window_cost.weighted(rows, hours)
    print(render_windows(window_cost.window_cost(mix, weight="weight"), window_cost.segmented_cost(mix, weight="weight"), window_cost.step_weights(rows, hours)))
    for r in missing.collect():  # one row for each declared source at most
        print(f"provisional: {r.source} has no profile yet")
    if DEFAULT.corpus.unsourced_hours:
        print(f"provisional: {DEFAULT.corpus.unsourced_hours:.0f} h are not collected yet")
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    sys.exit(main(session, sys.argv[1:]))
