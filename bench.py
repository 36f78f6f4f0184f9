"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is executed in full with a ``noop`` write (no rows are
collected to the driver); the time is wall-clock per query after one
warm-up query that starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinio.plans.catalog import QUERIES  # noqa: E402
from opinio.session import local_session  # noqa: E402

HEADLINE = [
    "cln01_clean_reviews",
    "prf02_stage_counts",
    "prf04_describe_numeric",
    "fea01_text_features",
    "agg05_text_features_by_company",
    "sen01_sentiment_scores",
    "agg11_polarity_share",
    "agg18_correlation_matrix",
    "cls01_keyword_classification",
    "ngr04_top20_bigrams",
    "ngr06_top10_trigrams_per_model_class",
    "ngr07_word_frequencies",
    "txt08_topic_text_chain",
    "top02_dictionary",
    "top05_lda_topic_terms",
    "top08_coherence_cv",
    "src03_review_blocks",
    "src08_reviews_per_product",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    QUERIES["agg01_rating_histogram"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()                           # nothing is left for the next query
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
