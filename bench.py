"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "aggregate_counts", "raw_counts", "premium_distribution", "premium_table", "cost_table", "coincidence_pairs",
    "coincidence_incomparable", "carry_forward", "corpus_fingerprint", "corpus_lines", "nfc_normalize", "utf32_encode",
    "unknown_count", "tokenization_lengths", "normalize_by_target", "parallel_intersection", "chart_usd_per_1k_units",
    "tax_gap", "adjacent_pairs", "bpe_count", "bpe_joined_count", "vocab_sweep", "token_text_alignment",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("glossmeter.spread", cpus)             # the tables of the bench are single files
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from glossmeter.plans.queries import QUERIES

    # one small run starts the Python workers and warms the code paths
    QUERIES["premium_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
