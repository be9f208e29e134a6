"""Text rewriting with a set of (find, put) pairs, as one native expression.

All pairs are applied in one left-to-right pass through a single alternation,
longest first and equal lengths by text, so that a replacement is never itself
rewritten and the result does not depend on any map order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import let

PAIR_TYPE = "array<struct<find:string,put:string>>"
TOKEN = "[A-Za-z0-9]"


def no_pairs() -> Column:
    return F.array().cast(PAIR_TYPE)


def make_pairs(find: Column, put: Column) -> Column:
    """Zip two equally long arrays into pairs."""
    return F.zip_with(find, put, lambda f, p: F.struct(f.alias("find"), p.alias("put")))


def _literal(text: Column) -> Column:
    """A regular expression that matches ``text`` itself."""
    return F.concat(
        F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


def rewrite(text: Column, pairs: Column, whole_token: bool = True) -> Column:
    """Replace every ``find`` by its ``put``.

    With ``whole_token`` a match may not touch an ASCII letter or digit on
    either side.  Pairs whose ``find`` does not occur are dropped before the
    pattern is built.
    """

    def apply(present: Column) -> Column:
        ordered = F.array_sort(
            F.transform(
                present,
                lambda p: F.struct(
                    (-F.length(p["find"])).alias("n"), p["find"].alias("f"), p["put"].alias("p")
                ),
            )
        )

        def run(items: Column) -> Column:
            body = F.array_join(F.transform(items, lambda e: _literal(e["f"])), "|")
            pattern = F.concat(F.lit("(?:"), body, F.lit(")"))
            if whole_token:
                pattern = F.concat(F.lit(f"(?<!{TOKEN})"), pattern, F.lit(f"(?!{TOKEN})"))
            put_of = F.map_from_arrays(
                F.transform(items, lambda e: e["f"]), F.transform(items, lambda e: e["p"])
            )
            return let(
                F.struct(pattern.alias("pattern"), put_of.alias("put_of")),
                lambda s: F.array_join(
                    F.zip_with(
                        F.split(text, s["pattern"], -1),
                        F.transform(
                            F.regexp_extract_all(text, s["pattern"], F.lit(0)),
                            lambda m: F.element_at(s["put_of"], m),
                        ),
                        lambda piece, put: F.concat(piece, F.coalesce(put, F.lit(""))),
                    ),
                    "",
                ),
            )

        return F.when(F.size(present) == 0, text).otherwise(let(ordered, run))

    present = F.filter(
        F.coalesce(pairs, no_pairs()), lambda p: (p["find"] != "") & text.contains(p["find"])
    )
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, let(present, apply)).otherwise(text)


def occurs(text: Column, find: Column) -> Column:
    """Whether a text holds ``find`` as whole tokens."""
    return text.rlike(F.concat(F.lit(f"(?<!{TOKEN})"), _literal(find), F.lit(f"(?!{TOKEN})")))


def redact(text: Column, values: Column, kinds: Column) -> Column:
    """Replace each value by ``[[kind]]``."""
    marks = F.transform(kinds, lambda k: F.concat(F.lit("[["), k, F.lit("]]")))
    return rewrite(text, make_pairs(values, marks))
