"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from frailscope.plans.catalog import queries
from frailscope.session import local_session

HEADLINE = [
    "frailty_summary",
    "frailty_summary_all_periods",
    "frailty_summary_chronic_lookback",
    "frailty_summary_with_polypharmacy",
    "category_prevalence",
    "random_index_visit",
    "washout_cohort",
    "events_raw",
    "events_by_category",
    "events_chronic_lookback_category",
    "events_by_source_code",
    "ingredients_over_1_day",
    "ingredients_overlapping",
    "ingredient_distribution",
    "fi_by_person_weighted",
    "fi_by_category",
    "rate_distribution",
    "category_icc",
    "reconciled_concepts",
    "code_patterns_to_concepts",
    "expanded_descendants",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("frailscope-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # starts the JVM's compilers and the file listing; not counted
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": scale,
            }
        )
    )


if __name__ == "__main__":
    main()
