"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

from graphloom.queries import QUERIES  # noqa: E402
from graphloom.session import session  # noqa: E402

HEADLINE = [
    "valence_per_activity",
    "quads_per_graph",
    "cross_tab_having",
    "optional_link_left_join",
    "text_filter_three_way_join",
    "period_activity_matrix",
    "shared_pairs_theta_self_join",
    "similarity_pairs_topk",
    "log_odds_terms",
    "inverted_index_search",
    "ffill_speakers",
    "rolling_mean_15",
    "temporal_parse",
    "bucket_range_join",
    "nquads_round_trip",
    "drop_and_rewrite_quads",
    "json_explode",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", spark__master=f"local[{cpus}]", spark__driver__memory="8g", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
