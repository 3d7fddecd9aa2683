"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Every query is written to the ``noop`` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.catalog import QUERIES  # noqa: E402
from tracewell.session import local_session  # noqa: E402

HEADLINE = {
    "extract_claims": "b01_extract_claim",
    "negated_terms": "b03_negated_terms",
    "similarity_join": "c01_similarity_join",
    "match_candidates": "e03_candidates",
    "vector_nearest": "c03_vector_nearest",
    "top_passages": "e05_top_passages",
    "readable_text": "b10_readable_text",
    "html_integrity": "b09_html_integrity",
    "merge_hits": "d03_merge_hits",
    "domain_cap": "e02_domain_cap",
    "snapshots": "b21_snapshots",
    "versions": "b33_versions",
    "compare_pairs": "f11_compare_pair",
    "mutations": "d11_mutations",
    "earliest_source": "d07_earliest_source",
    "chronological_ordinal": "e07_chronological_ordinal",
    "history_list": "e12_history_list",
    "request_limiter": "j01_request_limiter",
    "hierarchy_reach": "h03_hierarchy_reach",
    "outcome_counts": "d22_outcome_counts",
}


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="tracewell-bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["b07_url_key"](spark, directory).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for label, name in HEADLINE.items():
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[label] = round(time.perf_counter() - start, 3)
        print(f"{label}: {seconds[label]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
