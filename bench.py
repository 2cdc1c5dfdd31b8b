"""Time the headline queries and print one JSON line.

Each query is built and written to the no-op sink, so its whole result is computed; the time includes the jobs that run
while it is built. Queries are warmed once on the smallest data where it lies beside the bench data.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from driftline.catalog import QUERIES  # noqa: E402
from driftline.session import local_session  # noqa: E402
from driftline.sources.scratch import clear_scratch  # noqa: E402

HEADLINE = [
    "plan_copy", "delete_missing", "copy_counters", "attributes_to_fix", "snapshot_diff", "translate_renames",
    "copy_list_from_diff", "balance_by_bytes", "merge_manifest", "ancestor_join",
    "dataset_conflicts", "list_policies", "list_instances", "events_by_policy_name", "events_result", "policy_view",
    "validate_policies", "final_status", "recent_runs", "fold_properties", "diff_properties", "incremental_load",
    "retention_purge", "complete_runs", "mark_overlaps", "assemble_log_records", "search_logs", "copy_progress",
    "hive_run_progress", "decode_tracking", "tracking_update", "rehome_policies", "apply_entity_transforms",
    "changed_entities", "scan_tree", "stream_events", "stream_progress", "stream_last_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    seconds: dict[str, float] = {}
    for name in names:
        if os.path.isdir(small):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
