"""Time the headline queries; prints one JSON line.

Tables: ``$BENCH_SF_DIR`` (default sf0.1). Cores: ``$BENCH_CPUS`` (default all). Each query is
run to the end, all its columns computed and thrown away, so no result passes the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "word_counts_all",
    "vocabulary",
    "encode_ids_unk",
    "encode_ids_drop",
    "triples_ids",
    "sentence_row_triples",
    "corpus_stats",
    "captions_features",
    "labelled_ids",
    "train_validation_split",
    "shards",
    "batches",
    "padded_ids",
    "eval_arrays",
    "word_vectors",
    "mean_pool",
    "sentence_bow",
    "encoded_texts",
    "sentence_gru",
    "similarity_pearson",
    "nearest",
    "neighbour_overlap",
    "ranking_loss",
    "structure_alignment",
    "contrast_scores",
    "negative_sampling_loss",
    "expand_vocab_fitted",
]


def main() -> None:
    from sentloom.session import get_spark
    from workload.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = get_spark(
        "sentloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The session's first job pays for class loading and worker start; it is not a query's time.
    QUERIES["encode_ids_unk"](spark, folder.replace("sf0.1", "sf0.01")).write.format("noop").mode(
        "overwrite"
    ).save()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
