"""Scrubbing of texts, each with its own map.

Everything one text needs is in its row: the plan is a single stage without a
shuffle (scan, detect, bind, rewrite, check again), whatever the size of the
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import looks_like_csv
from ..operators import spans as sp
from ..operators.bind import bind_rows
from ..operators.candidates import rule_spans
from ..operators.detect import HIT_TYPE, detect_hits, first_by
from ..operators.finder import DEFAULT_STRATEGY, Model, find_spans
from ..operators.rewrite import make_pairs, rewrite
from ..operators.tabular import csv_text_cells

FOUND_TYPE = "array<struct<pos:int,text:string,kind:string,source:string,essential:boolean>>"
NO_TEXT = "array<string>"


def found_in_text(
    text: Column, hits: Column, contextual: Column | None, source: str, csv: bool,
    is_csv: Column,
) -> Column:
    """All spans of a text in order of first sight: hard identifiers, then table
    cells or contextual spans; the first verdict on a text stands."""

    def entry(value: Column, kind: Column, origin: str, essential: Column) -> Column:
        return F.struct(
            value.alias("text"), kind.alias("kind"), F.lit(origin).alias("source"),
            essential.alias("essential"),
        )

    no = F.lit(False)
    empty = F.array().cast("array<struct<text:string,kind:string,source:string,essential:boolean>>")
    hard = F.transform(hits, lambda h: entry(h["value"], h["kind"], "regex", no))
    soft = empty
    if contextual is not None:
        soft = F.transform(
            contextual, lambda s: entry(s["text"], s["kind"], source, s["essential"])
        )
    if csv:
        cells = F.transform(
            csv_text_cells(text), lambda c: entry(c["text"], c["kind"], "csv", no)
        )
        soft = F.when(is_csv, cells).otherwise(soft)
    numbered = F.transform(
        F.concat(hard, soft),
        lambda e, i: F.struct(
            i.alias("pos"), e["text"].alias("text"), e["kind"].alias("kind"),
            e["source"].alias("source"), e["essential"].alias("essential"),
        ),
    )
    return first_by(numbered, lambda e: e["text"], lambda e: e["pos"])


def survivors(text: Column, fakes: Column) -> Column:
    """Hard identifiers of a rewritten text that are no (part of a) replacement and
    hold none: two replacements side by side can look like one identifier, and
    binding that would put replacements, not real values, into the map."""
    return F.filter(
        detect_hits(text),
        lambda h: ~F.exists(fakes, lambda f: f.contains(h["value"]) | h["value"].contains(f)),
    )


def scrub(
    df: DataFrame,
    text: str = "text",
    contextual: str | Model | None = "rules",
    strategy: str = DEFAULT_STRATEGY,
    instructions: dict | None = None,
    csv: bool = True,
) -> DataFrame:
    """Add ``scrubbed``, ``spans``, ``mapping`` and ``warnings`` to a table of texts.

    ``contextual`` is the finder for prose: ``"rules"`` (deterministic), a model
    function or table of stored answers, or ``None`` for hard identifiers and tables only.  ``mapping`` goes
    from replacement to real value.  Works on streaming tables unchanged.
    """
    keep = [c for c in df.columns]
    t = F.col(text)
    work = df.withColumn("_csv", looks_like_csv(t)) if csv else df.withColumn("_csv", F.lit(False))
    work = work.withColumn("warnings", F.array().cast(NO_TEXT))
    soft, source = None, "rules"
    if callable(contextual) or isinstance(contextual, DataFrame):
        found = find_spans(
            work.drop("warnings"), contextual, text, strategy, instructions, ~F.col("_csv")
        )
        work, soft, source = found, F.col("model_spans"), "model"
    elif contextual == "rules":
        soft = F.when(F.col("_csv"), sp.no_spans()).otherwise(rule_spans(t))
    elif contextual is not None:
        raise ValueError(f"unknown finder {contextual!r}")

    work = work.withColumn("_hits", detect_hits(t))
    work = work.withColumn(
        "_found", found_in_text(t, F.col("_hits"), soft, source, csv, F.col("_csv"))
    )
    work = work.withColumn("_bound", F.filter("_found", lambda e: ~e["essential"]))
    work = work.withColumn("_real", F.transform("_bound", lambda e: e["text"]))
    kinds = F.transform("_bound", lambda e: e["kind"])
    work = work.withColumn(
        "_fake", F.coalesce(bind_rows(F.col("_real"), kinds), F.array().cast(NO_TEXT))
    )
    work = work.withColumn(
        "_once", rewrite(t, make_pairs(F.col("_real"), F.col("_fake")))
    )

    # Second look: identifiers that are still there after rewriting. Only a
    # rewritten text can hold any that the first look did not bind.
    work = work.withColumn(
        "_left",
        F.when(F.size("_real") > 0, survivors(F.col("_once"), F.col("_fake"))).otherwise(
            F.array().cast(HIT_TYPE)
        ),
    )
    work = work.withColumn(
        "_new", F.filter("_left", lambda h: ~F.array_contains("_real", h["value"]))
    )
    work = work.withColumn("_new_real", F.transform("_new", lambda h: h["value"]))
    new_kinds = F.transform("_new", lambda h: h["kind"])
    work = work.withColumn(
        "_new_fake",
        F.coalesce(
            bind_rows(
                F.col("_new_real"), new_kinds, F.col("_fake"),
                F.concat("_real", "_new_real"),
            ),
            F.array().cast(NO_TEXT),
        ),
    )
    work = work.withColumn("_all_real", F.concat("_real", "_new_real"))
    work = work.withColumn("_all_fake", F.concat("_fake", "_new_fake"))
    still = F.filter(
        make_pairs(F.col("_all_real"), F.col("_all_fake")),
        lambda p: F.exists("_left", lambda h: h["value"] == p["find"]),
    )
    work = work.withColumn("_still", still)
    work = work.withColumn(
        "scrubbed",
        F.when(F.size("_left") > 0, rewrite(F.col("_once"), F.col("_still"))).otherwise(
            F.col("_once")
        ),
    )
    return work.withColumn("spans", _spans()).withColumn(
        "mapping", F.map_from_arrays("_all_fake", "_all_real")
    ).select(*keep, "scrubbed", "spans", "mapping", "warnings")


def _spans() -> Column:
    """Spans as reported: text, fake, category, source, essential, scrubbed."""

    def report(text, fake, category, source, essential) -> Column:
        return F.struct(
            text.alias("text"), fake.alias("fake"), category.alias("category"),
            source.alias("source"), essential.alias("essential"),
            (~essential).alias("scrubbed"),
        )

    first = F.transform(
        "_found",
        lambda e: report(
            e["text"],
            F.when(e["essential"], e["text"]).otherwise(
                F.get("_fake", F.array_position("_real", e["text"]).cast("int") - 1)
            ),
            e["kind"], e["source"], e["essential"],
        ),
    )
    known = F.transform("_found", lambda e: e["text"])
    second = F.transform(
        F.filter(
            F.arrays_zip("_new", "_new_fake"),
            lambda z: ~F.array_contains(known, z["_new"]["value"]),
        ),
        lambda z: report(
            z["_new"]["value"], z["_new_fake"], z["_new"]["kind"],
            F.lit("regex-backstop"), F.lit(False),
        ),
    )
    return F.concat(first, second)


def span_table(scrubbed: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of scrubbed texts as rows."""
    from ..operators.detect import explode_in_order

    return explode_in_order(scrubbed.select(*keys, "spans"), "spans", "ord", "_s").select(
        *keys, "ord", "_s.*"
    )


def mapping_table(scrubbed: DataFrame, scope: str) -> DataFrame:
    """The maps of scrubbed texts as rows ``scope, fake, real``."""
    return scrubbed.select(F.col(scope).alias("scope"), F.explode_outer("mapping")).where(
        F.col("key").isNotNull()
    ).select("scope", F.col("key").alias("fake"), F.col("value").alias("real"))
