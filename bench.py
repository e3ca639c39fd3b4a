"""Time the headline queries over the sample tables; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from runledger.catalog.queries import QUERIES
from runledger.session import build_session

HEADLINE = (
    "parse_header",
    "parse_results",
    "build_attrs",
    "build_map",
    "lookup_default",
    "hash_match_rules",
    "path_job_match",
    "line_match",
    "recent_n_unique",
    "job_hashes",
    "latest_commit_per_file",
    "upsert_lineitem",
    "upsert_last_wins",
    "ledger_by_hash",
    "markdown_lines",
    "csv_roundtrip",
    "aligned_report",
    "incremental_equals_batch",
    "run_results",
    "full_run",
    "reports_as_written",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["parse_header"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
