"""A training corpus from documents: quality, lines, near copies, secrets, packing.

``STAGES`` are run in order, each over all that the one before kept; every result
is written as Parquet and read again.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskwright.llm.jaccard import link_near_copies
from maskwright.llm.line_dedup import remove_later_lines
from maskwright.llm.packing import pack_scrubbed
from maskwright.llm.quality import good_texts
from maskwright.llm.queries import WORD_BPE
from maskwright.llm.secret_scan import labelled_findings, redact_secrets, train_network
from maskwright.storage import checkpoint_dir, cut_lineage, own_cuts


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns, with ``n_chars`` as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are too frequent on their host."""
    return _counted(good_texts(docs), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose words match those of an earlier one."""
    return _counted(remove_later_lines(docs), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies."""
    with own_cuts(spark) as keep:
        linked = link_near_copies(docs, key="doc_id")
        kept = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
        kept = keep(cut_lineage(kept.withColumnRenamed("doc_id", "kept_id"), "kept"))
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return left.dropDuplicates(["doc_id", "text"])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    network = train_network(*labelled_findings(docs))
    return _counted(redact_secrets(docs, network), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return pack_scrubbed(docs, WORD_BPE, text="text")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies),
          ("secret scans", secrets), ("best-fit packing", packing)]

# Tokenizers and a trained network cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
