"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed into a sink that consumes every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p1_clean_text", "p2_clean_text_strip_routing", "p17_header_feature_row", "p19_html_to_text", "x1_x2_feature_frame",
    "s7_p21_p22_provider_ingest", "m3_word_vocabulary", "m3b_char_vocabulary", "m4_tfidf_word", "l11_sentiment",
    "w1_stratified_sample", "w6b_dedup_by_clean_text", "w11_stratified_folds", "w14_half_split", "j12_label_noise",
    "a5_class_report", "a11_confidence_distribution", "a12_gate_sweep", "a13_pair_frequency", "a19_feature_class_means",
    "a15_corrections_until_retrain", "a24_status_summary", "r2_correction_upsert", "r6_sessions", "l5_threshold_and_argmax", "m10_forest_bucket",
]
# Costly fits run once: no warm-up.
ONCE = {"l5_threshold_and_argmax", "m10_forest_bucket"}


def main() -> None:
    from mailtriage.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    from mailtriage.plans import catalog

    times = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        for _ in range(1 if name in ONCE else 2):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rate = {n: round(docs / times[n]) for n in ("p1_clean_text", "x1_x2_feature_frame", "m4_tfidf_word", "l5_threshold_and_argmax")}
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "documents_per_second": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
