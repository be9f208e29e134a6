"""Scoring of detection strategies: leaks, recall, over-scrub, extra, ranking.

Cases are ``(id, task, text, pii, essential)``; outputs are ``(strategy, id,
scrubbed, spans, error)`` with ``spans`` an array of ``struct<text, scrubbed>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def must_remove(pii: Column, essential: Column) -> Column:
    """Labels that may not survive; repeats count as often as they are listed."""
    return F.filter(pii, lambda p: ~F.array_contains(essential, p))


def score_cases(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per (strategy, case); one equi-join on the case id.

    A failed case counts as recall 0 with one ``<error>`` leak.
    """
    none = F.array().cast("array<string>")
    pii = F.coalesce("pii", none)
    essential = F.coalesce("essential", none)
    failed = F.col("error").isNotNull()
    joined = outputs.select("strategy", "id", "scrubbed", "spans", "error").join(
        cases.select("id", "task", pii.alias("pii"), essential.alias("essential")), "id"
    )
    joined = joined.withColumn("must", must_remove(F.col("pii"), F.col("essential")))
    text = F.col("scrubbed")
    shown = F.transform(
        F.filter("spans", lambda s: F.coalesce(s["scrubbed"], F.lit(False))), lambda s: s["text"]
    )
    joined = joined.withColumn("leaks", F.filter("must", lambda p: text.contains(p)))
    removed = F.size("must") - F.size("leaks")
    recall = F.when(F.size("must") == 0, F.lit(1.0)).otherwise(
        F.bround(removed / F.size("must"), 3)
    )

    def unless_failed(value: Column, instead: Column) -> Column:
        return F.when(failed, instead).otherwise(value)

    return joined.select(
        "strategy", "id", F.coalesce("task", F.lit("?")).alias("task"),
        unless_failed(recall, F.lit(0.0)).alias("recall"),
        unless_failed(F.col("leaks"), F.array(F.lit("<error>"))).alias("leaks"),
        unless_failed(
            F.filter(F.array_distinct("essential"), lambda e: ~text.contains(e)), none
        ).alias("over_scrubbed"),
        unless_failed(
            F.filter(shown, lambda t: ~F.array_contains(F.col("pii"), t)), none
        ).alias("extra_scrubbed"),
        unless_failed(F.size("must"), F.size("pii")).alias("n_pii"),
        "error",
    )


def score_strategies(scores: DataFrame) -> DataFrame:
    """Totals per strategy."""
    return scores.groupBy("strategy").agg(
        F.bround(F.avg("recall"), 3).alias("mean_recall"),
        F.sum(F.size("leaks")).alias("total_leaks"),
        F.sum(F.size("over_scrubbed")).alias("total_over_scrub"),
        F.sum(F.size("extra_scrubbed")).alias("total_extra"),
        F.count(F.lit(1)).alias("n_cases"),
    )


def rank_strategies(summary: DataFrame) -> DataFrame:
    """Fewest leaks, then highest recall, least over-scrub, least extra.

    The window has no partition: its input is one row per strategy.
    """
    order = Window.orderBy(
        "total_leaks", F.desc("mean_recall"), "total_over_scrub", "total_extra", "strategy"
    )
    return summary.withColumn("rank", F.row_number().over(order))


def case_report(scores: DataFrame) -> DataFrame:
    """Readable line per case."""
    notes = F.concat_ws(
        "; ",
        F.when(F.size("leaks") > 0, F.concat(
            F.lit("LEAK:"), F.substring(F.array_join("leaks", ","), 1, 36))),
        F.when(F.size("over_scrubbed") > 0, F.concat(
            F.lit("over:"), F.substring(F.array_join("over_scrubbed", ","), 1, 20))),
    )
    return scores.select(
        "strategy", "id", "task", "recall", F.size("leaks").alias("n_leaks"),
        F.size("over_scrubbed").alias("n_over"), notes.alias("notes"),
    )


def select_cases(cases: DataFrame, split: str = "all", case_id: str | None = None) -> DataFrame:
    """Cases of a split (an absent split means dev), optionally a single case."""
    out = cases
    if split != "all":
        out = out.where(F.coalesce("split", F.lit("dev")) == split)
    return out if case_id is None else out.where(F.col("id") == case_id)


def cache_key(version: Column, strategy: Column, text: Column) -> Column:
    """Key of a stored result: same version, strategy and text, same key."""
    joined = F.concat(version, F.lit("\0"), strategy, F.lit("\0"), text)
    return F.substring(F.sha2(joined, 256), 1, 16)


def missing_results(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``wanted(cache_key, ...)`` that have no stored result yet."""
    return wanted.join(stored.select("cache_key").distinct(), "cache_key", "left_anti")
