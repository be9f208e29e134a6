"""Stored results of strategies: computed once per key, appended, used again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.score import missing_results
from ..storage import cut_lineage


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results stored so far, one row per ``cache_key``; none if nothing was stored.

    Results of a key are equal by the meaning of the key, so a part that was appended twice
    (a run that was lost and repeated) counts once.
    """
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).dropDuplicates(["cache_key"])


def cached_results(
    wanted: DataFrame, path: str, schema: str, produce: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Results of all ``wanted`` rows ``(cache_key, ...)``, stored ones and new ones.

    ``produce`` makes ``schema``, with ``cache_key``, from the rows without a stored result, one per
    key; what it gives is appended to ``path``.  Returns ``wanted`` with the other
    columns of the results.
    """
    spark = wanted.sparkSession
    before = stored_results(spark, path, schema)
    misses = missing_results(wanted, before).dropDuplicates(["cache_key"])
    new = cut_lineage(produce(misses), "new-results")
    known = cut_lineage(before.join(wanted.select("cache_key").distinct(), "cache_key", "left_semi"), "known-results")
    new.write.mode("append").parquet(path)
    return wanted.join(known.unionByName(new), "cache_key")
