"""Scrubbing where many texts share one map: conversations, or a whole dataset.

Detection stays in the row.  Only distinct values are shuffled, bound and
joined back, so a scope with a third of all texts is split like any other data.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import let
from ..functions.text import (
    csv_fields, looks_like_csv, looks_like_csv_lines, text_lines, trim_spaces,
)
from ..operators.bind import bind_values, first_seen
from ..operators.candidates import rule_spans
from ..operators.detect import detect_hits, explode_in_order
from ..operators.finder import DEFAULT_STRATEGY, Model, find_spans
from ..operators.occur import attach_pairs
from ..operators.rewrite import no_pairs, occurs, rewrite
from ..operators.tabular import classify_header, csv_cells, csv_text_cells
from ..storage import cut_lineage
from .scrub import survivors


class Scrubbed(NamedTuple):
    """Scrubbed texts, the map ``(scope, real, fake, kind)`` and the spans."""

    texts: DataFrame
    mapping: DataFrame
    spans: DataFrame


def _values(
    found: DataFrame, order: list[str], step: int, source: str, essential: Column | None = None
) -> DataFrame:
    """Found values with their place in the scope's order of sight and the verdict."""
    return found.select(
        "scope", "real", "kind",
        F.struct(
            F.lit(step).alias("step"), F.col("rule").alias("rule"), F.struct(*order).alias("at"),
            F.col("pos").alias("pos"), F.lit(source).alias("source"),
            (F.lit(False) if essential is None else essential).alias("essential"),
        ).alias("ord"),
    )


def _hard_values(rows: DataFrame, order: list[str], column: str, step: int, source: str) -> DataFrame:
    hits = explode_in_order(rows.select("scope", *order, column), column, "_i", "_h")
    found = hits.select(
        "scope", *order, F.col("_h.value").alias("real"), F.col("_h.kind").alias("kind"),
        F.col("_h.rule").alias("rule"), F.col("_h.pos").alias("pos"),
    )
    return _values(found, order, step, source)


def table_scopes(rows: DataFrame, order: list[str], text: str) -> DataFrame:
    """Scopes whose texts, one after another, read as a table.

    Returns ``(scope, kinds, header_at, header_ix)``.  Only the first 31 lines
    of a scope matter, and the row limit is applied before the shuffle.
    """
    limit = fv.CSV_SAMPLE_ROWS + 1
    lines = F.filter(
        F.transform(text_lines(F.col(text)), lambda l, i: F.struct(i.alias("ix"), l.alias("line"))),
        lambda e: e["line"] != "",
    )
    heads = explode_in_order(
        rows.select("scope", *order, F.slice(lines, 1, limit).alias("_l")), "_l", "_i", "_e"
    ).select("scope", F.struct(*order).alias("at"), "_e.ix", "_e.line")
    first = Window.partitionBy("scope").orderBy("at", "ix")
    top = heads.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit)
    scopes = top.groupBy("scope").agg(
        F.array_sort(F.collect_list(F.struct("_r", "at", "ix", "line"))).alias("_top")
    )
    header = F.get(F.filter("_top", lambda e: trim_spaces(e["line"]) != ""), F.lit(0))
    return scopes.where(
        looks_like_csv_lines(F.transform("_top", lambda e: e["line"]))
    ).withColumn("_h", header).select(
        "scope",
        F.transform(csv_fields(F.col("_h.line")), classify_header).alias("kinds"),
        F.col("_h.at").alias("header_at"),
        F.col("_h.ix").alias("header_ix"),
    )


def _cell_values(cells: DataFrame, order: list[str], source: str) -> DataFrame:
    """Values of ``(scope, order, _c)`` with an array of text and kind per row."""
    found = explode_in_order(cells, "_c", "pos", "_e").select(
        "scope", *order, F.col("_e.text").alias("real"), F.col("_e.kind").alias("kind"),
        F.lit(0).alias("rule"), "pos",
    )
    return _values(found, order, 1, source)


def _table_values(rows: DataFrame, tables: DataFrame, order: list[str], text: str) -> DataFrame:
    joined = rows.select("scope", *order, text).join(tables, "scope")
    lines = F.filter(
        F.transform(text_lines(F.col(text)), lambda l, i: F.struct(i.alias("ix"), l.alias("line"))),
        lambda e: (trim_spaces(e["line"]) != "")
        & ~((F.struct(*order) == F.col("header_at")) & (e["ix"] == F.col("header_ix"))),
    )
    cells = csv_cells(F.transform(lines, lambda e: e["line"]), F.col("kinds"))
    return _cell_values(joined.select("scope", *order, cells.alias("_c")), order, "csv")


def _model_values(found: DataFrame, order: list[str]) -> DataFrame:
    """Spans of a model, each with its own verdict."""
    rows = explode_in_order(found.select("scope", *order, "model_spans"), "model_spans", "pos", "_e")
    rows = rows.select(
        "scope", *order, F.col("_e.text").alias("real"), F.col("_e.kind").alias("kind"),
        F.lit(0).alias("rule"), "pos", F.col("_e.essential").alias("essential"),
    )
    return _values(rows, order, 1, "model", F.col("essential"))


def _pairs(mapping: DataFrame) -> DataFrame:
    return mapping.select("scope", F.col("real").alias("find"), F.col("fake").alias("put"))


def scrub_scoped(
    df: DataFrame,
    scope: str | None,
    order: list[str],
    text: str = "text",
    contextual: str | Model | None = None,
    csv: bool | str = "scope",
    existing: DataFrame | None = None,
    strategy: str = DEFAULT_STRATEGY,
    instructions: dict | None = None,
) -> Scrubbed:
    """Scrub texts with one map per ``scope`` (``None``: one map for all).

    ``contextual`` is the finder for prose: ``"rules"``, a model (a function or a table of
    stored answers, see ``operators.finder``) or ``None``.  A model sees each text by itself; what it
    says is gathered per scope, and the first verdict on a value, in the order of
    ``order``, stands for all texts of the scope.  A value first called essential is kept
    everywhere and listed in ``spans`` with ``scrubbed = false``; one that a pattern
    or table column found before is not kept.  With a model the texts get ``warnings``
    about chunks that were checked for fixed patterns only.

    ``order`` columns tell the texts of a scope apart and order them.  ``csv``
    says what may be a table: the texts of a ``"scope"`` one after another (a
    chat that pastes a table in parts), each ``"text"`` alone, or nothing
    (``False``).  ``existing`` is an earlier map ``(scope, real, fake)`` to go on with.
    """
    by_model = callable(contextual) or isinstance(contextual, DataFrame)
    if not by_model and contextual not in (None, "rules"):
        raise ValueError("a finder is 'rules', a model or none")
    csv = "scope" if csv is True else csv
    if csv not in ("scope", "text", False):
        raise ValueError("csv is 'scope', 'text' or False")
    given = df.columns
    rows = df.withColumn(
        "scope", F.col(scope).cast("string") if scope else F.lit("all")
    ).withColumnRenamed(text, "_text")
    t = F.col("_text")
    look = rows.select("scope", *order, "_text").withColumn("_hits", detect_hits(t))
    values = _hard_values(look, order, "_hits", 0, "regex")
    prose, is_prose = rows.select("scope", *order, "_text"), F.lit(True)
    if csv == "text":
        is_prose = ~looks_like_csv(t)
        cells = F.when(is_prose, None).otherwise(csv_text_cells(t))
        values = values.unionByName(
            _cell_values(prose.select("scope", *order, cells.alias("_c")), order, "csv"))
    elif csv == "scope":
        tables = cut_lineage(table_scopes(rows, order, "_text"), "tables")
        if not tables.isEmpty():
            values = values.unionByName(_table_values(rows, tables, order, "_text"))
            prose = prose.join(tables.select("scope"), "scope", "left_anti")
    if by_model:
        # Asked once and written: the answers are used for values and for warnings.
        asked = rows.drop("warnings").withColumn("_prose", is_prose)
        if csv == "scope" and not tables.isEmpty():
            asked = asked.join(tables.select("scope", F.lit(False).alias("_table")), "scope", "left")
            asked = asked.withColumn("_prose", F.coalesce("_table", F.lit(True))).drop("_table")
        rows = cut_lineage(
            find_spans(asked, contextual, "_text", strategy, instructions, F.col("_prose")), "asked")
        values = values.unionByName(_model_values(rows, order))
        rows = rows.drop("_prose", "model_spans")
    elif contextual == "rules":
        found = prose.select("scope", *order, F.when(is_prose, rule_spans(t)).alias("_c"))
        values = values.unionByName(_cell_values(found, order, "rules"))

    firsts = first_seen(values, "scope", "real", "kind", F.col("ord"))
    if by_model:
        firsts = cut_lineage(firsts, "verdicts")
    bound = firsts.where(~F.col("ord.essential")) if by_model else firsts
    mapping = cut_lineage(bind_values(bound, existing), "mapping")
    applied = mapping.select("scope", "real", "fake")
    if existing is not None:
        applied = applied.unionByName(
            existing.select("scope", "real", "fake").join(
                applied.select("scope", "real"), ["scope", "real"], "left_anti"
            )
        )

    # Second look at the rewritten texts, with the stand-ins of each text itself.
    once = attach_pairs(rows, _pairs(applied), order, "_text")
    once = once.withColumn("scrubbed", rewrite(t, F.col("pairs")))
    own = F.transform("pairs", lambda p: p["put"])
    once = cut_lineage(once.withColumn(
        "_left",
        F.when(F.size("pairs") > 0, let(own, lambda o: survivors(F.col("scrubbed"), o))),
    ).withColumnRenamed("pairs", "_own"), "once")
    left = _hard_values(once, order, "_left", 2, "regex-backstop").join(
        applied.select("scope", F.col("fake").alias("real")), ["scope", "real"], "left_anti"
    )
    left = cut_lineage(left, "left")
    final, replaced = once, None
    if not left.isEmpty():
        new = left.join(applied.select("scope", "real"), ["scope", "real"], "left_anti")
        more = cut_lineage(
            bind_values(first_seen(new, "scope", "real", "kind", F.col("ord")), applied), "more")
        again = applied.join(left.select("scope", "real"), ["scope", "real"], "left_semi")
        again = again.unionByName(more.select("scope", "real", "fake"))
        seen = attach_pairs(once, _pairs(again), order, "scrubbed")
        # Stand-ins of the first look are matched by themselves, so none is cut up.
        held = F.filter(
            F.transform(
                F.coalesce("_own", no_pairs()),
                lambda p: F.struct(p["put"].alias("find"), p["put"].alias("put")),
            ),
            lambda p: ~F.exists("pairs", lambda q: q["find"] == p["find"]),
        )
        final = seen.withColumn(
            "scrubbed",
            F.when(F.size("pairs") > 0, rewrite(F.col("scrubbed"), F.concat("pairs", held)))
            .otherwise(F.col("scrubbed")),
        )
        hit = F.filter("pairs", lambda p: occurs(F.col("scrubbed"), p["find"]))
        replaced = explode_in_order(
            seen.select("scope", hit.alias("_h")), "_h", "_i", "_p"
        ).select("scope", F.col("_p.find").alias("real")).distinct().withColumn("_put", F.lit(True))
        mapping = mapping.unionByName(more)
    given = [c for c in given if not (by_model and c == "warnings")]
    texts = final.withColumnRenamed("_text", text).select(
        *given, "scrubbed", *["warnings"] * by_model)
    spans = mapping.withColumn("scrubbed", F.lit(True))
    if replaced is not None:
        second = F.col("ord.source") == "regex-backstop"
        spans = mapping.join(replaced, ["scope", "real"], "left").withColumn(
            "scrubbed", ~second | F.coalesce("_put", F.lit(False)))
    spans = spans.select(
        "scope", F.col("real").alias("text"), "fake", F.col("kind").alias("category"),
        F.col("ord.source").alias("source"), F.lit(False).alias("essential"), "scrubbed",
    )
    if by_model:
        spans = spans.unionByName(firsts.where("ord.essential").select(
            "scope", F.col("real").alias("text"), F.col("real").alias("fake"),
            F.col("kind").alias("category"), F.col("ord.source").alias("source"),
            F.lit(True).alias("essential"), F.lit(False).alias("scrubbed")))
    return Scrubbed(texts, mapping.select("scope", "real", "fake", "kind"), spans)


def scrub_conversations(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text",
    contextual: str | Model | None = "rules", **options,
) -> Scrubbed:
    """Scrub chat turns; all turns of a conversation share one map."""
    return scrub_scoped(df, conversation, [turn], text, contextual, **options)


def scrub_dataset(
    df: DataFrame, key: str = "doc_id", text: str = "text", contextual: str | Model | None = None,
    csv: bool = True, **options,
) -> Scrubbed:
    """Scrub all texts of a dataset with one map; each text may be a table of its own."""
    return scrub_scoped(df, None, [key], text, contextual, "text" if csv else False, **options)
