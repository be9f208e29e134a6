"""Paragraphs whose words are split over several formatted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.detect import explode_in_order
from ..operators.occur import attach_pairs
from ..operators.rewrite import rewrite

PARAGRAPH = ["path", "part", "para"]


def paragraph_texts(runs: DataFrame) -> DataFrame:
    """Runs ``(path, part, para, run, text)`` put together per paragraph."""
    text = F.coalesce("text", F.lit(""))
    grouped = runs.groupBy(*PARAGRAPH).agg(
        F.array_sort(F.collect_list(F.struct("run", text.alias("text")))).alias("_runs")
    )
    return grouped.withColumn(
        "text", F.array_join(F.transform("_runs", lambda r: r["text"]), "")
    )


def scrub_runs(runs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite whole paragraphs with the map ``(scope, real, fake)`` of their path.

    The first run of a paragraph receives the rewritten text, the others become
    empty.
    """
    paragraphs = paragraph_texts(runs).withColumn("scope", F.col("path").cast("string"))
    pairs = mapping.select(
        F.col("scope").cast("string").alias("scope"),
        F.col("real").alias("find"), F.col("fake").alias("put"),
    )
    held = attach_pairs(paragraphs, pairs, PARAGRAPH)
    held = held.withColumn("_new", rewrite(F.col("text"), F.col("pairs")))
    rows = explode_in_order(
        held.select(*PARAGRAPH, "_new", F.transform("_runs", lambda r: r["run"]).alias("_r")),
        "_r", "_i", "run",
    )
    return rows.select(
        *PARAGRAPH, "run", F.when(F.col("_i") == 0, F.col("_new")).otherwise("").alias("text")
    )
