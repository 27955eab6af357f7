"""Times the headline queries and prints one JSON line.

Each query runs twice on the whole tables of ``$BENCH_SF_DIR``; the second,
warm run counts. Nothing is kept between the runs but the stored vocabulary
and weight tables, which a user would keep on disk too.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokenloom.plans.queries import all_queries  # noqa: E402

HEADLINE = [
    "clean_cut_t1",
    "bert_normalize_t2",
    "token_counts_v1",
    "write_vocabulary_s9",
    "unpivot_first_seen_p3",
    "assign_batches_p9",
    "wordpiece_t4",
    "truncate_words_t5",
    "truncate_pieces_t6",
    "encode_ids_t7",
    "piece_usage_v4",
    "expand_vocab_v7",
    "init_weights_e2",
    "embed_corpus_e3",
    "static_encode_e4",
    "exported_encode_e4",
    "cosine_scores_e6",
    "nearest_k_e7",
    "cells_search_e7",
    "contrastive_loss_d2",
    "gradient_step_d4",
    "sts_correlation_m1",
    "ndcg_at_k_m2",
    "nearest_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # The test tables are single files of one row group, which one task would read.
        .config("tokenloom.inputPartitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        for _ in range(2):
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = {
        f"{name}_documents_per_sec": round(documents / seconds[name])
        for name in ("token_counts_v1", "encode_ids_t7", "static_encode_e4")
        if name in seconds
    }
    if "exported_encode_e4" in seconds:  # short texts, as a model's queries are
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
        rows["exported_encode_e4_turns_per_sec"] = round(turns / seconds["exported_encode_e4"])
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "rates": rows,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
