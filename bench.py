"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from docloom.catalog.queries import QUERIES
from docloom.session import local_session

HEADLINE = [
    "scan_corpus", "filter_ignore_rules", "document_properties", "title_inference", "headings", "heading_tree", "toc", "code_blocks",
    "links", "images", "tasks", "table_cells", "line_numbers", "html_links", "heading_id", "build_page_index", "resolve_links",
    "broken_links", "resolve_anchors", "image_dimensions", "nearest_parent", "sibling_position", "descendant_count", "traceable",
    "reorder_plan", "duplicate_titles", "change_detection", "sync_plan", "property_diff", "attachment_diff", "incremental_sync",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["headings"](spark, directory).write.format("noop").mode("overwrite").save()  # warm up the JVM
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
