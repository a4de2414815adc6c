"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a21_token_f1", "j18_token_overlap", "w1_allocate_quota", "w2_credit_ledger", "w4_subscription_state", "a6_suite_report",
    "a15_page_topology", "f23_stress_scores", "j7_name_match", "j19_near_duplicate_lines", "w8_segment_sections",
    "f26_injection_score", "f29_classification_rules", "f33_diagnostic_detectors", "f5_html_to_text", "f11_contact_extraction",
    "j10_cache_split", "j14_align_sections", "j16_diff_bullets", "w15_enrich_paragraphs",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from bindings import registry
    from bindings.views import view

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="quire-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    queries = registry.queries()
    times: dict[str, float] = {}

    def timed(name, f):
        t0 = time.perf_counter()
        f()
        times[name] = round(time.perf_counter() - t0, 3)

    # Session start-up, and the two views that are written once per session.
    timed("prepare_views", lambda: (view(spark, sf, "v_li"), view(spark, sf, "v_resume_lines")))
    for n in names:
        timed(n, lambda n=n: queries[n](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
