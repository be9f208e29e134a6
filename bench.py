"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, functions as F

from maskwright.operators.detect import detect_hard_ids
from maskwright.operators.tabular import scrub_table
from maskwright.plans.restore import restore_text
from maskwright.plans.scoped import scrub_conversations, scrub_dataset
from maskwright.plans.scrub import scrub
from maskwright.queries import QUERIES, table
from maskwright.storage import cut_lineage, local_session


def run(df: DataFrame) -> None:
    """Compute every column of every row without keeping the result."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def docs() -> DataFrame:
        return table(spark, sf_dir, "documents", "doc_id", "text")

    size = docs().agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    # Written once: restoring reads stored texts, as it would in use.
    stored = cut_lineage(scrub(docs(), contextual=None), "bench").repartition(8, "doc_id")
    stored = cut_lineage(stored.select("doc_id", "scrubbed", "mapping"), "bench")

    jobs = {
        "hard_id_scan": lambda: run(detect_hard_ids(docs())),
        "scrub_documents": lambda: run(scrub(docs(), contextual=None)),
        "scrub_documents_rules": lambda: run(scrub(docs())),
        "restore_documents": lambda: run(stored.withColumn(
            "text", restore_text(F.col("scrubbed"), F.col("mapping")))),
        "scrub_conversations": lambda: run(scrub_conversations(
            table(spark, sf_dir, "conversations"), contextual=None).texts),
        "scrub_dataset": lambda: run(scrub_dataset(docs(), csv=False).texts),
        "scrub_customer_table": lambda: run(scrub_table(table(spark, sf_dir, "customer"))[0]),
        "chunks": lambda: run(QUERIES["chunks"](spark, sf_dir)),
        "dual_lens_merge": lambda: run(QUERIES["dual_lens_merge"](spark, sf_dir)),
        "score_strategies": lambda: run(QUERIES["score_strategies"](spark, sf_dir)),
    }
    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    scan, full = seconds["hard_id_scan"], seconds["scrub_documents"]
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents": size[0],
        "scan_mb_per_s": round(size[1] / 1e6 / scan, 2),
        "scan_docs_per_s": round(size[0] / scan),
        "scrub_docs_per_s": round(size[0] / full),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
