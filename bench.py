"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables      (default /root/testdata/sf0.1)
BENCH_CPUS     local executor threads    (default 8)
BENCH_QUERIES  comma list, or 'all'      (default: the headline list)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolemill import catalog
from rolemill.catalog.registry import QUERIES
from rolemill.session import build_session

HEADLINE = [
    "load_report",
    "increment_load",
    "filter_duplicates",
    "prioritized_update_match",
    "application_match",
    "merge_fill_blank",
    "scrape_to_stage",
    "upsert_jobs",
    "location_winner",
    "medium_c_rate",
    "keyword_rate",
    "daily_stats_totals",
    "daily_stats_by_source",
    "deleted_reason_counts",
    "daily_quota",
    "issue_leases",
    "build_mart",
    "html_to_text",
    "extract_jsonld",
    "extract_cards",
    "parse_rate_response",
    "run_all",
    "stream_daily_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    catalog.load()
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    shared = tempfile.mkdtemp(prefix="rolemill-bench-")
    spark = build_session("bench", cpus, shuffle=int(cpus), shared=shared)
    for name in ("status_counts", "load_report"):  # start the JVM's compilers; not timed
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


main()
