"""Deterministic name candidates: cue phrases, trigger phrases, capitalised runs.

All of it is regular expressions over one text, so it runs in the scan stage
and yields ``array<struct<text, kind>>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.hashing import let
from ..functions.text import trim_spaces
from .detect import explode_in_order, first_by

CANDIDATE_TYPE = "array<struct<text:string,kind:string>>"
WORD = r"[A-Za-z0-9'’-]"
QUOTES = " \"'“”‘’"


# What a match of each pattern begins with.  Looked at before all else, as most places
# of a text can begin no match and a word edge is dear to test.  Where a pattern ignores
# case, the Kelvin sign counts as a k.
CUE_STARTS = ["[mo][yu]", "[cC]", "[pi][rn]", "th"]
TRIGGER_STARTS = [
    "[cCdDnNkK\u212a]", "[moht][yuieh]", "[A-Z]", "[to][hu]", "[piotsr][rnpeq]", "[MDP][rsx]",
    "[\"“”'’]",
]


def _quick(start: str, pattern: str) -> str:
    return f"(?={start}){pattern}"


def _captures(text: Column, patterns: list[tuple[str, str]], starts: list[str]) -> Column:
    """Group 1 of every match of every pattern, pattern by pattern."""

    def of(kind: str, pattern: str, start: str) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit("(?U)" + _quick(start, pattern)), F.lit(1)),
            lambda m: F.struct(m.alias("text"), F.lit(kind).alias("kind")),
        )

    return F.concat(*(of(*rule, start) for rule, start in zip(patterns, starts, strict=True)))


def _numbered(items: Column) -> Column:
    return F.transform(
        items,
        lambda c, i: F.struct(i.alias("pos"), c["text"].alias("text"), c["kind"].alias("kind")),
    )


def _distinct_lower(items: Column) -> Column:
    """First candidate per lower-cased text, in order."""
    firsts = first_by(_numbered(items), lambda c: F.lower(c["text"]), lambda c: c["pos"])
    return F.transform(
        firsts, lambda c: F.struct(c["text"].alias("text"), c["kind"].alias("kind"))
    )


def cue_candidates(text: Column) -> Column:
    """Names announced by a relation, a codename cue or a project noun."""
    found = F.transform(
        _captures(text, fv.CUE_PATTERNS, CUE_STARTS),
        lambda c: F.struct(trim_spaces(c["text"]).alias("text"), c["kind"].alias("kind")),
    )
    kept = F.filter(
        found,
        lambda c: (c["text"] != "") & ~F.lower(c["text"]).isin(fv.SENTENCE_WORDS),
    )
    return F.coalesce(_distinct_lower(kept), F.array().cast(CANDIDATE_TYPE))


def _capitalised_run_pattern() -> str:
    """One to three eligible capitalised words, single spaces between them.

    The first word may not be a public technology term, nor a common word at a
    sentence start; later words may not be public technology terms.
    """
    end = f"(?!{WORD})"
    public = f"(?!(?i:{'|'.join(fv.PUBLIC_TECH)}){end})"
    acronyms = f"(?!(?:{'|'.join(fv.ACRONYMS)}){end})"
    word = (
        f"(?:[A-Z][a-z’'-]{{2,}}{end}|[A-Z][a-z]+[A-Z][A-Za-z0-9]*{end}"
        f"|{acronyms}[A-Z]{{3,10}}{end})"
    )
    at_start = r"(?:(?<=[.!?\n:])|(?<=[.!?\n:][\s\S])|\A)"
    common = f"(?!{at_start}(?i:{'|'.join(fv.SENTENCE_WORDS)}){end})"
    # All three kinds of words begin with a capital, which is quick to see.
    return _quick("[A-Z]", f"(?<!{WORD}){public}{common}{word}(?: {_quick('[A-Z]', public + word)}){{0,2}}")


CAPITALISED_RUN = _capitalised_run_pattern()


def mechanical_candidates(text: Column) -> Column:
    """Trigger phrases first, then capitalised runs."""
    runs = F.transform(
        F.regexp_extract_all(text, F.lit(CAPITALISED_RUN), F.lit(0)),
        lambda m: F.struct(m.alias("text"), F.lit("other_sensitive").alias("kind")),
    )
    edge = f"^[{QUOTES}]+|[{QUOTES}]+$"
    found = F.transform(
        F.concat(_captures(text, fv.TRIGGER_PATTERNS, TRIGGER_STARTS), runs),
        lambda c: F.struct(
            F.regexp_replace(c["text"], edge, "").alias("text"), c["kind"].alias("kind")
        ),
    )
    kept = F.filter(
        found,
        lambda c: (F.length(c["text"]) >= 2) & ~F.lower(c["text"]).isin(fv.HARD_STOP_WORDS),
    )
    return F.coalesce(_distinct_lower(kept), F.array().cast(CANDIDATE_TYPE))


def rule_spans(text: Column) -> Column:
    """The finder used when no model is supplied: cues, then mechanical candidates."""
    both = _distinct_lower(F.concat(cue_candidates(text), mechanical_candidates(text)))
    return F.transform(
        both,
        lambda c: F.struct(
            c["text"].alias("text"), c["kind"].alias("kind"), F.lit(False).alias("essential")
        ),
    )


def cap_candidates(texts: Column) -> Column:
    """The leading candidates that fit a prompt: 40 entries, 600 characters.

    An entry fits while the characters so far plus its own stay within the
    limit; each entry counts one more for its line break; the first that does
    not fit ends the list.
    """
    start = F.struct(
        F.lit(0).alias("chars"),
        F.lit(False).alias("full"),
        F.array().cast("array<string>").alias("kept"),
    )

    def step(acc: Column, c: Column) -> Column:
        stop = (
            acc["full"]
            | (F.size(acc["kept"]) >= fv.CANDIDATE_ENTRIES)
            | (acc["chars"] + F.length(c) > fv.CANDIDATE_CHARS)
        )
        return F.when(
            stop,
            F.struct(acc["chars"].alias("chars"), F.lit(True).alias("full"), acc["kept"].alias("kept")),
        ).otherwise(F.struct(
            (acc["chars"] + F.length(c) + 1).alias("chars"),
            F.lit(False).alias("full"),
            F.concat(acc["kept"], F.array(c)).alias("kept"),
        ))

    # Nothing past the entry limit can be kept, so nothing past it is looked at.
    return F.aggregate(
        F.slice(texts, 1, fv.CANDIDATE_ENTRIES), start, step, lambda acc: acc["kept"]
    )


def candidate_block(texts: Column, empty: str = "(none)") -> Column:
    """Capped candidates as one block, one per line."""
    return let(
        cap_candidates(texts),
        lambda kept: F.when(F.size(kept) == 0, F.lit(empty)).otherwise(F.array_join(kept, "\n")),
    )


def candidate_rows(
    df: DataFrame, finder, text: str = "text", keys: list[str] | None = None
) -> DataFrame:
    """Candidates as rows ``keys, ord, text, kind``."""
    keys = keys or [c for c in df.columns if c != text]
    rows = df.select(*keys, finder(F.col(text)).alias("_c"))
    return explode_in_order(rows, "_c", "ord", "_e").select(*keys, "ord", "_e.text", "_e.kind")
