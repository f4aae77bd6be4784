"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Derived input is written before the clock starts.  Each query runs to the end
once to warm up and once timed; its rows are counted, not kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from credsift.operators import matching
from credsift.session import build_session
from workloads import derive
from workloads.queries import QUERIES, _match_lines, document_entries

HEADLINE = (
    "scan_documents", "scan_pages", "scan_conversations", "user_rule_inline_token", "match_rules_all", "rule_hits",
    "redact_text", "split_lines", "scan_stats", "validate_repo_url", "classify_scan_error",
    "anchored_window_count", "rate_limit_flags", "reachable_commits", "tree_diff_introducing", "scan_repo_history",
)


def timed(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "credsift-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for sql in (derive.PLANTED_DOCUMENTS, derive.PLANTED_PAGES, derive.PLANTED_TURNS, derive.REQUESTS,
                derive.OUTCOMES, derive.COMMITS, derive.TREE_FILES, derive.BLOBS):
        derive.derived(spark, sf_dir, sql)

    seconds: dict[str, float] = {}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            timed(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - start)
        seconds[name] = round(runs[-1], 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)

    result = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
              "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}

    if not sys.argv[1:]:
        # rule matching alone, with and without gate and anchors, on the planted documents
        entries = document_entries(spark, sf_dir)
        size = entries.agg(F.sum(F.octet_length("content"))).first()[0]
        lines = entries.agg(F.sum(F.size(F.split(F.col("content").cast("string"), "\n", -1)))).first()[0]
        with_anchors = timed(matching.match_rules(_match_lines(entries)))
        all_lines = entries.select(F.explode(F.split(F.col("content").cast("string"), "\n", -1)).alias("line"))
        # every pattern on every line, but for very long ones; the figure is over the bytes of the lines it takes
        short = all_lines.where(F.octet_length("line") <= 4096)
        short_size = short.agg(F.sum(F.octet_length("line") + 1)).first()[0]
        without = timed(matching.match_rules(short, anchored=False))
        result["matching"] = {
            "bytes": size, "lines": lines,
            "anchored_sec": round(with_anchors, 3), "anchored_mb_per_sec": round(size / with_anchors / 1e6, 2),
            "anchored_lines_per_sec": round(lines / with_anchors),
            "all_patterns_sec": round(without, 3), "all_patterns_bytes": short_size,
            "all_patterns_mb_per_sec": round(short_size / without / 1e6, 2),
        }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
