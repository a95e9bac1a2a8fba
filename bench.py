"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cuelake.plans import QUERIES
from cuelake.session import local_session

HEADLINES = [
    "transcript_qa_decision", "sync_report", "freeze_plan_trim", "retimed_captions", "split_long_cues",
    "wrapped_srt", "caption_qa", "glossary_check", "resolve_segments", "clip_captions", "artifact_versions",
    "active_artifacts", "approval_validity", "next_action", "state_history", "transition_audit", "event_counts",
    "stage_rollup", "resume_plan", "catalog_enriched", "playlist_merge", "language_plan", "final_qa",
    "budget_admission", "sync_report_trim", "sync_cues", "batch_results", "lineage", "stream_project_state",
    "stream_activity", "transcript_documents", "glossary_documents", "srt_roundtrip", "activity_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = local_session("cuelake-bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in wanted:
        for _ in range(2):  # the second run counts: the first one compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
