"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from loomstone.plans import registry
from loomstone.session import get_session

HEADLINE = [
    "text_stats_source",
    "line_length_hist",
    "top_chars",
    "top_words",
    "dataset_report",
    "column_profile",
    "convert_mixed_records",
    "convert_fallback_ladder",
    "render_chatml",
    "assistant_char_spans",
    "pack_sequences",
    "train_val_split",
    "shifted_pairs",
    "sft_pad_truncate",
    "pretoken_counts",
    "bpe_merges",
    "encode_docs",
    "pack_bpe_sequences",
    "sft_mask_bpe",
    "admission_decisions",
    "rolling_rate_limit",
    "usage_by_day",
    "latest_run_state",
    "loss_curve_scaled",
    "log_tail",
    "project_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "loomstone-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
