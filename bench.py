"""Seconds per headline query, on the folder in BENCH_SF_DIR with BENCH_CPUS cores. Prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.session import build_session

HEADLINE = (
    "val11_verdicts", "val19_validation_report", "agg01_key_metrics", "agg06_geographic_distribution", "agg07_invoice_summary",
    "agg19_quarterly_breakdown", "win01_growth", "win02_supplier_performance", "prj10_search_invoices", "jn05_items_with_product",
    "jn08_amount_within_1000", "dup03_similar_amount", "dup04_shared_hsn", "dup05_candidate_union", "dup12_exact_matches",
    "dup15_verdicts", "cls07_decision", "txt02_intent", "reg01_validate_gstin", "jn12_fuzzy_name_join", "rsk02_reasoning_confidence",
    "bat01_batch_summary", "nst02_form_fields", "ext07_line_items", "pag01_taxpayer_pages", "str04_session_activity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    from ledgerloom.catalog import QUERIES

    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
