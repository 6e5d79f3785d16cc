"""Headline queries at one scale; prints one JSON line.

    BENCH_SF_DIR  folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores            (default 8)
    BENCH_RUNS    timed runs per query   (default 1, after one warm-up)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sheaf.plans import QUERIES
from sheaf.session import build_session

HEADLINE = (
    "flagship_relevant_text",
    "a4_keyed_json_scan",
    "a6_tei_documents",
    "b4_first_link_per_base",
    "c1_conformed_records",
    "d2_concat_texts",
    "d5_one_row_per_doi",
    "e14_test_pair_scores",
    "e23_macro_f1",
    "e_record_evaluation",
    "k6_records_per_molecule",
    "k9_running_records",
    "k16_records_by_order",
    "m4_molecule_features",
    "m9_linear",
    "m13_knn_regression",
    "p1_expanded_tests",
    "p4_humidity",
    "p13_formula_amounts",
    "r8_filtered_documents",
    "r9_chunks_above_percentile",
    "t2_keyword_filter",
    "t4_tfidf",
    "t5_train_test",
    "t7_naive_bayes",
    "v5_box_statistics",
    "x5_parse_outcome",
    "x7_repair_json",
)


def seconds(spark, name: str, folder: str, runs: int) -> float:
    def once() -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return statistics.median(once() for _ in range(runs))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    times = {name: round(seconds(spark, name, folder, runs), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
