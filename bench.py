"""Times the headline queries and prints one JSON line.

Every query runs whole into Spark's no-op sink, once to warm up and then once for the
figure. ``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local cores.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from truthmill.plans.catalog import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "credibility_features",
    "export_features",
    "page_extract",
    "regex_tokens",
    "analyzer_chain",
    "stem_tokens",
    "bag_of_words",
    "corpus_word_count",
    "class_count_outer_join",
    "vocabulary_index",
    "tfidf_weights",
    "ml_idf",
    "sentiment_scores",
    "similar_news",
    "cosine_topk",
    "train_test_union",
    "latest_k",
    "jsonl_repair",
    "eval_report",
    "roc_curve",
    "auc_metrics",
    "nb_theta",
    "page_link_list",
    "model_lr",
    "word2vec_docs",
    "similar_pairs",
    "nearest_vectors",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("truthmill-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
