"""Benchmark: run the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is written to the no-op sink, so every row and column is computed. The time includes building
the query.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from pathlib import Path

from contactmill.plans.queries import registered
from contactmill.session import local_session

HEADLINE = [
    "score_leads", "score_summary", "score_applied_rules", "leads_top_scored", "leads_with_valid_email",
    "reenrich_queue", "best_email_per_lead", "extended_stats", "listing_filter_counts", "ingest_dedup",
    "ingest_counters", "verify_decision", "enroll_eligible", "enroll_due", "advance_steps",
    "rendered_steps", "send_plan", "outreach_eligible", "send_stats", "latest_send_status", "export_flat",
    "export_nested", "emails_in_documents", "hidden_emails_in_documents", "default_features",
    "page_features", "site_features", "contact_links", "strip_html", "rolling_breaker",
    "backoff_history", "stream_latest_status", "stream_daily_sent", "stream_domain_backoff",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    shared = tempfile.mkdtemp(prefix="contactmill-bench-")
    spark = local_session(
        cpus, "contactmill-bench", **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared}
    )
    queries = registered()
    # Start the JVM's code paths and the Python workers before the clock does.
    queries["leads_count"](spark, folder).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
