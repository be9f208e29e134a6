"""Contextual spans: reading answers, merging lists, gates.

A list of spans belongs to one text or chunk, so every operator here is a
column expression over ``array<struct<text, kind, essential>>`` and none of
them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import let
from ..functions.text import trim_spaces
from .detect import explode_in_order, first_by

SPAN_TYPE = "array<struct<text:string,kind:string,essential:boolean>>"
BULLET = r"^[-* .\p{N}]+"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def span(text: Column, kind: Column, essential: Column) -> Column:
    return F.struct(
        text.alias("text"), kind.alias("kind"), essential.cast("boolean").alias("essential")
    )


def normalize_kind(label: Column) -> Column:
    """Known kind for a loosely written label."""

    def decide(k: Column) -> Column:
        out = F.when(k.isin(fv.CONTEXT_KINDS), k)
        for kind, words in fv.KIND_SYNONYMS.items():
            out = out.when(k.isin(words), kind)
        return out.otherwise("other_sensitive")

    return let(F.translate(trim_spaces(F.lower(label)), " -", "__"), decide)


def _first_by_text(spans: Column, key) -> Column:
    numbered = F.transform(
        spans, lambda s, i: F.struct(i.alias("pos"), key(s).alias("key"), s.alias("s"))
    )
    return F.transform(
        first_by(numbered, lambda n: n["key"], lambda n: n["pos"]), lambda n: n["s"]
    )


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def _answer_lines(raw: Column) -> Column:
    lines = F.transform(F.split(raw, "\n"), trim_spaces)
    return F.filter(lines, lambda l: (l != "") & (F.upper(l) != "NONE"))


def parse_response(raw: Column, source: Column) -> Column:
    """Spans of an answer with lines ``text | kind | essential``.

    Only short texts that occur verbatim in ``source`` count; the first line of
    a text decides.
    """

    def parts(line: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(line, BULLET, ""), r"\|", -1), trim_spaces)

    def as_span(p: Column) -> Column:
        return span(
            F.get(p, F.lit(0)),
            F.when(F.size(p) > 1, normalize_kind(F.get(p, F.lit(1)))).otherwise("other_sensitive"),
            F.coalesce(F.lower(F.get(p, F.lit(2))).isin(fv.ESSENTIAL_WORDS), F.lit(False)),
        )

    def valid(s: Column) -> Column:
        t = s["text"]
        return (
            (t != "")
            & source.contains(t)
            & (F.length(t) <= fv.MAX_SPAN_CHARS)
            & (_word_count(t) <= fv.MAX_SPAN_WORDS)
            & ~t.contains("?")
            & ~t.contains("!")
        )

    spans = F.transform(F.transform(_answer_lines(raw), parts), as_span)
    kept = _first_by_text(F.filter(spans, valid), lambda s: s["text"])
    return F.coalesce(kept, no_spans())


def parse_candidates(raw: Column, source: Column) -> Column:
    """Candidate texts of an answer with one candidate per line."""

    def valid(t: Column) -> Column:
        return (
            source.contains(t)
            & (F.length(t) <= fv.MAX_SPAN_CHARS)
            & (_word_count(t) <= fv.MAX_ENUMERATED_WORDS)
            & ~t.contains("?")
            & ~t.contains("!")
        )

    return F.coalesce(
        distinct_lower_texts(F.filter(_answer_lines(raw), valid)), F.array().cast("array<string>")
    )


def distinct_lower_texts(texts: Column) -> Column:
    """First text per lower-cased form, in order."""
    numbered = F.transform(texts, lambda t, i: F.struct(i.alias("pos"), t.alias("t")))
    return F.transform(
        first_by(numbered, lambda n: F.lower(n["t"]), lambda n: n["pos"]), lambda n: n["t"]
    )


def union_spans(*lists: Column) -> Column:
    """Spans of all lists; the earlier list wins for texts equal but for case."""
    every = F.concat(*(F.coalesce(l, no_spans()) for l in lists))
    return _first_by_text(every, lambda s: trim_spaces(F.lower(s["text"])))


def is_public_tech(text: Column) -> Column:
    return F.lower(text).isin(fv.PUBLIC_TECH)


def dual_lens_merge(general: Column, names: Column) -> Column:
    """Union of a general pass and a name pass.

    A name-pass span must start upper-case, be no public technology term and
    neither hold nor lie within a general span; it is never essential.
    """

    def merge(a: Column) -> Column:
        low_a = F.transform(a, lambda s: F.lower(s["text"]))

        def keep(lows: Column) -> Column:
            def fits(s: Column) -> Column:
                low = F.lower(s["text"])
                return (
                    s["text"].rlike(r"^\p{Lu}")
                    & ~is_public_tech(s["text"])
                    & ~F.exists(lows, lambda t: t.contains(low) | low.contains(t))
                )

            kept = F.filter(F.coalesce(names, no_spans()), fits)
            return F.transform(kept, lambda s: span(s["text"], s["kind"], F.lit(False)))

        return union_spans(a, let(low_a, keep))

    return let(F.coalesce(general, no_spans()), merge)


def merge_cues(cues: Column, candidates: Column) -> Column:
    """Cue texts first, then listed candidates, without repeats."""
    return distinct_lower_texts(F.concat(F.transform(cues, lambda c: c["text"]), candidates))


def force_cues(classified: Column, cues: Column) -> Column:
    """Keep every cue candidate that classification dropped."""
    as_spans = F.transform(cues, lambda c: span(c["text"], c["kind"], F.lit(False)))
    return union_spans(classified, as_spans)


def audit_gate(audit: Column, first_pass: Column, text: Column) -> Column:
    """Noise gates for spans found in an already redacted text."""

    def names_something(s: Column) -> Column:
        t = s["text"]
        prefix = F.lit(False)
        for p in fv.RELATION_PREFIXES:
            prefix = prefix | F.lower(t).startswith(p)
        return (
            ~t.contains("[[")
            & ~t.contains("]]")
            & ~is_public_tech(t)
            & (t.rlike(r"\p{Lu}") | prefix)
        )

    def near_trigger(s: Column) -> Column:
        # Place and window are worked out once per span, not once per trigger word.
        def triggers(window: Column) -> Column:
            near = window.contains("[[")
            for word in fv.AUDIT_TRIGGERS:
                near = near | window.contains(word)
            return near

        def around(at: Column) -> Column:
            start = F.greatest(at - fv.AUDIT_WINDOW, F.lit(1))
            stop = at + F.length(s["text"]) + fv.AUDIT_WINDOW
            return (at > 0) & let(F.lower(text.substr(start, stop - start)), triggers)

        return let(F.instr(text, s["text"]), around)

    def gate(kept: Column) -> Column:
        limit = F.greatest(F.lit(fv.AUDIT_FLOOR), F.size(first_pass) * 2)
        return F.when(F.size(kept) > limit, F.filter(kept, near_trigger)).otherwise(kept)

    return let(F.filter(F.coalesce(audit, no_spans()), names_something), gate)


def span_rows(df: DataFrame, spans: str, keys: list[str]) -> DataFrame:
    """Spans as rows ``keys, ord, text, kind, essential``."""
    return explode_in_order(df.select(*keys, spans), spans, "ord", "_s").select(
        *keys, "ord", "_s.text", "_s.kind", "_s.essential"
    )
