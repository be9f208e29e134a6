"""Hard-identifier detection with native regular expressions.

Detection is a pure function of one text, so it needs no shuffle: the rules run
inside the scan stage and the result is an array in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import let
from ..functions.text import luhn_valid

HIT_TYPE = "array<struct<rule:int,pos:int,value:string,kind:string>>"

# A text that fails a rule's precondition cannot match the rule. Each one starts
# at a rare character and is far cheaper than the rule; rules without an entry
# measured no slower than any precondition for them.
PRECONDITIONS = {
    0: lambda t: t.contains("@"),
    2: lambda t: t.contains("_"),
    3: lambda t: t.rlike(r"(?iU)\.(?:internal|corp|local|lan|intranet)\b"),
    4: lambda t: t.rlike(r"(?U)\d\.\d{1,3}\.\d"),
    5: lambda t: t.rlike(r"[A-Fa-f0-9]:[A-Fa-f0-9]{1,4}:"),
    8: lambda t: t.rlike(r"(?U)[ \-.]\d{3}[ \-.]\d{4}"),
}


def _rule_hits(text: Column, rule: int) -> Column:
    kind, pattern = fv.HARD_ID_RULES[rule]
    found = F.transform(
        F.regexp_extract_all(text, F.lit(fv.REGEX_FLAGS + pattern), F.lit(0)),
        lambda m, i: F.struct(
            F.lit(rule).alias("rule"),
            i.alias("pos"),
            F.trim(m).alias("value"),
            F.lit(kind).alias("kind"),
        ),
    )

    def valid(hit: Column) -> Column:
        ok = F.length(hit["value"]) >= fv.MIN_HARD_ID_LENGTH
        if kind == "credit_card":
            ok = ok & luhn_valid(hit["value"])
        if kind == "api_key":
            ok = ok & ~hit["value"].rlike(r"^\p{N}+$")
        return ok

    hits = F.filter(found, valid)
    if rule not in PRECONDITIONS:
        return hits
    return F.when(PRECONDITIONS[rule](text), hits).otherwise(F.array().cast(HIT_TYPE))


def first_by(items: Column, key, order) -> Column:
    """Keep the first item per ``key`` in ``order``; the result is in ``order``.

    Sorting twice keeps this at n log n for a text with very many items.
    """
    def keep_firsts(keyed: Column) -> Column:
        firsts = F.filter(
            keyed, lambda e, i: (i == 0) | (F.get(keyed, i - 1)["k"] != e["k"])
        )
        in_order = F.array_sort(F.transform(firsts, lambda e: F.struct(e["o"], e["x"])))
        return F.transform(in_order, lambda e: e["x"])

    def dedup(items: Column) -> Column:
        keyed = F.array_sort(
            F.transform(
                items, lambda x: F.struct(key(x).alias("k"), order(x).alias("o"), x.alias("x"))
            )
        )
        return F.when(F.size(items) < 2, items).otherwise(let(keyed, keep_firsts))

    return let(items, dedup)


def detect_hits(text: Column) -> Column:
    """Distinct hard identifiers of a text, first rule first, as ``HIT_TYPE``."""
    every = F.concat(*(_rule_hits(text, r) for r in range(len(fv.HARD_ID_RULES))))
    return F.coalesce(
        first_by(every, lambda h: h["value"], lambda h: F.struct(h["rule"], h["pos"])),
        F.array().cast(HIT_TYPE),
    )


def detect_hard_ids(df: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """One row per distinct hard identifier of each text.

    Returns the key columns with ``ord, value, kind``.
    """
    keys = keys or [c for c in df.columns if c != text]
    hits = df.select(*keys, detect_hits(F.col(text)).alias("_hits"))
    return explode_in_order(hits, "_hits", "ord", "_hit").select(
        *keys, "ord", F.col("_hit.value").alias("value"), F.col("_hit.kind").alias("kind")
    )


def explode_in_order(df: DataFrame, array: str, ord_name: str, item_name: str) -> DataFrame:
    """One row per array element with its index; rows with an empty array vanish.

    The outer form matters: for an inner explode Catalyst infers a filter on the
    array's size and pushes it below the projection, which would run the
    expression that makes the array a second time.
    """
    rest = [c for c in df.columns if c != array]
    out = df.select(*rest, F.posexplode_outer(array).alias(ord_name, item_name))
    return out.where(F.col(ord_name).isNotNull())


def span_summary(spans: DataFrame, by: list[str] | None = None, rollup: bool = False) -> DataFrame:
    """Span counts per group, by default (category, source, scrubbed)."""
    by = by or ["category", "source", "scrubbed"]
    grouped = spans.rollup(*by) if rollup else spans.groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("n"))
