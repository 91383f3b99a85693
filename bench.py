"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from groundwork import catalogue
from groundwork.session import build_session

HEADLINE = (
    "chunk_documents", "document_frequency", "search_topk", "search_scoped", "ask_flagship", "ask_inline_passages", "verify_reasons",
    "verify_conversations", "eval_summary", "median_metric", "sha256_dedupe", "transition_check_parse", "searchable_flags", "ext_bm25",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cpus, shuffle_partitions=2 * int(cpus), driver_memory="16g")
    for name in HEADLINE[:2]:  # warm up
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
