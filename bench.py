"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "exposure_composite", "top_ads_per_brand", "brand_angle_breakdown", "angle_leaderboard", "niche_benchmark", "brand_deviations", "angle_whitespace", "creative_competitors", "creative_velocity", "proven_winners",
    "offer_counts", "ad_dedupe_merge", "word_count", "term_count_lexicon", "classify_lexicon", "ngram_document_frequency", "signature_terms", "page_meta", "link_extract", "signal_scoring", "alias_merge",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from adlens.catalogue import load

    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue, took = load(), {}
    names = [x for x in sys.argv[1:] if x in catalogue] or list(HEADLINE)
    for name in names:
        started = time.time()
        catalogue[name][0](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
