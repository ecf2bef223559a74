"""Times the headline queries once each and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` select the tables and the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from evenhand.session import local_session  # noqa: E402
from suite import all_queries  # noqa: E402

HEADLINE = [
    "e9_experiment_summary",
    "e9_experiment_summary_lineitem",
    "e6_binary_flip",
    "f3_random_probe",
    "f4_full_probe_summary",
    "f4_full_probe_lineitem",
    "f4_f7_full_probe",
    "f6_boundary_probe",
    "f8_probe_summaries",
    "g2_observed_pairs",
    "g2_observed_pairs_lineitem",
    "g8_first_counterexample",
    "g3_box_linear",
    "g4_box_regions",
    "c1_median_large",
    "c9_exact_split_orders",
    "c11_dense_index_two_keys",
    "h5_solver_summary",
    "h13_gate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    # start-up of the JVM and of the code generator is not a query
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every row is computed; nothing is sent to the driver
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "fairness audit queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
