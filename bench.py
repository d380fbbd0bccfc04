"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line.

Each query is run to completion through a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "cell_means", "response_matrix", "pairwise_correlation", "co_preference_similarity", "item_neighbours",
    "condition_report", "scorer_kappa", "film_positions", "person_scores", "neighbour_scores", "group_ranking",
    "partition_agreement_null", "co_engagement_permutation_test", "coherence_permutation_test",
    "spectrum_common_factors", "parallel_analysis", "common_factor_groups", "split_half_overlap",
    "taste_factors", "profile_reliability", "taste_adjusted_positions", "person_placement",
    "distinct_statements", "evidence_packets",
)


def main() -> None:
    from accordant.plans.registry import load_all
    from accordant.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    entries = load_all()
    names = [n for n in HEADLINE if n in entries and (len(sys.argv) < 2 or n in sys.argv[1:])]
    entries["cell_means"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
