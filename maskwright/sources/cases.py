"""Labelled cases as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.score import select_cases

CASE_SCHEMA = (
    "id string, task string, text string, pii array<string>, essential array<string>, "
    "hardness string, split string"
)


def read_eval_cases(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    return select_cases(spark.read.schema(CASE_SCHEMA).json(path), split)
