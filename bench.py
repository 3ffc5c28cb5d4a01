"""Runs the headline queries and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import load_all
from tidemark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "object_access_stats co_access_pairs join_graph discover_domains process_queries extraction_summary mine_metrics "
    "query_patterns relations_inferred merge_relations watch_states match_class search drift_manifest set_baseline "
    "transfer_opportunities stratified_split root_cause load_order repeated_passages duplicate_content "
    "extract_review_metadata generic_edges monthly_growth win_loss json_paths stream_cost_window"
).split()


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    seconds = {}
    queries["region_warmup"] = queries["storage_rollup"]
    for name in ["region_warmup", *HEADLINE]:
        begin = time.perf_counter()
        queries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        if name in HEADLINE:
            seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
