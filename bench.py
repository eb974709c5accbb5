"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query writes all of its rows to a null sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from symloom.queries import QUERIES  # noqa: E402
from symloom.session import get_session  # noqa: E402

HEADLINE = [
    "policy_presence", "glob_matches", "first_file_of_names", "body_references", "context_snippets", "symbol_occurrences",
    "pseudonymize_by_join", "pseudonymize_by_table", "pseudonymize_code", "symbols_markup", "symbols_code", "declarations_code",
    "function_inventory", "wrap_eligibility", "generated_rules", "blocks_code", "strip_comments_lexed", "remove_calls_code",
    "literals_markup", "kept_literals_markup", "literal_policy_report", "rule_exceptions", "renameable_names", "match_external",
    "match_sdk", "descendant_closure", "ancestor_paths", "updated_flags", "compared_exclusions", "far_clusters",
    "replacement_mapping", "closest_symbols", "resolved_targets", "step_states", "last_lines", "region_depths",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session("symloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").count().collect()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
