"""String checks and splitters as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .hashing import let

LINE_BREAK_CHARS = r"\n\r\u000b\u000c\u0085\u2028\u2029"
LINE_BREAK = rf"\r\n|[{LINE_BREAK_CHARS}]"
EDGE_SPACE = r"^[\t\p{Zs}]+|[\t\p{Zs}]+$"
QUOTED = '"[^"]*+(?:""[^"]*+)*+(?:"|$)'


def trim_spaces(text: Column) -> Column:
    """Drop tabs and Unicode space separators at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def luhn_valid(text: Column) -> Column:
    """Luhn checksum over the digits of ``text``; false below 13 digits."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, v: a + v)
    return (F.length(digits) >= fv.MIN_CARD_DIGITS) & (total % 10 == 0)


def text_lines(text: Column) -> Column:
    """Lines of a text, split at any line break (CRLF counts once)."""
    return F.split(text, LINE_BREAK, -1)


def csv_field_count(line: Column) -> Column:
    """Number of fields of a row; quotes may open mid-field or stay open to the end."""
    return F.size(F.split(F.regexp_replace(line, QUOTED, "Q"), ",", -1))


def csv_fields(line: Column) -> Column:
    """Unquoted fields of a row as ``array<string>``."""
    raw = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(f',((?:[^",]++|{QUOTED})*+)'), F.lit(1)
    )

    def unquote(field: Column) -> Column:
        parts = F.regexp_extract_all(field, F.lit(f'{QUOTED}|[^"]++'), F.lit(0))
        opened = F.transform(
            parts,
            lambda p: F.when(
                p.startswith('"'),
                F.replace(
                    F.regexp_replace(p, '(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"|$)$', "$1"),
                    F.lit('""'),
                    F.lit('"'),
                ),
            ).otherwise(p),
        )
        return F.when(field.contains('"'), F.array_join(opened, "")).otherwise(field)

    return F.transform(raw, unquote)


def looks_like_csv_lines(lines: Column) -> Column:
    """Table test over non-empty lines (the header first).

    Only the first 31 lines and whether there are at least three matter, so a
    caller may pass just those.
    """

    def judge(counted: Column) -> Column:
        columns = F.get(counted["n"], F.lit(0))
        sample = F.slice(counted["n"], 2, fv.CSV_SAMPLE_ROWS)
        exact = F.size(F.filter(sample, lambda n: n == columns))
        return (
            (F.size(counted["n"]) >= fv.CSV_MIN_LINES)
            & counted["header"].contains(",")
            & (columns >= fv.CSV_MIN_COLUMNS)
            & (exact * 100 >= F.size(sample) * fv.CSV_MATCH_PERCENT)
        )

    def count(ls: Column) -> Column:
        return F.struct(
            F.get(ls, F.lit(0)).alias("header"), F.transform(ls, csv_field_count).alias("n")
        )

    return F.coalesce(let(lines, lambda ls: let(count(ls), judge)), F.lit(False))


def looks_like_csv(text: Column) -> Column:
    """Whether a text is a delimited table rather than prose.

    A table needs two commas in its first line and a second line; a text
    without them is never split.  The rule looks at 31 non-empty lines, so a long
    text is cut there before it is split.
    """
    line, gap = f"[^{LINE_BREAK_CHARS}]", f"[{LINE_BREAK_CHARS}]"
    # One more piece for breaks in front and one for the rest, which is never looked at.
    wanted = fv.CSV_SAMPLE_ROWS + 1
    pieces = F.split(text, f"{gap}+", wanted + 2)
    lines = F.slice(F.filter(pieces, lambda l: l != ""), 1, wanted)
    word = f"[^,{LINE_BREAK_CHARS}]*+"
    maybe = text.rlike(f"^{gap}*+{word},{word},{line}*+{gap}")
    return F.when(maybe, looks_like_csv_lines(lines)).otherwise(False)


def chunk_text(
    text: Column, budget: int = fv.CHUNK_BUDGET, overlap: int = fv.CHUNK_OVERLAP
) -> Column:
    """Overlapping windows as ``array<struct<start, chunk>>`` (start is 0-based).

    A window ends after the last newline or space of its final 200 characters
    when there is one, and the next window begins ``overlap`` before that end.
    """
    n = F.length(text)
    stride = max(1, budget - fv.CHUNK_LOOKBACK - overlap)
    steps = F.sequence(F.lit(0), (n / F.lit(stride)).cast("int") + 1)
    start = F.struct(
        F.lit(0).alias("i"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<start:int,cut:int>>").alias("out"),
    )

    def step(acc: Column, _: Column) -> Column:
        i = acc["i"]
        end = F.least(i + budget, n)
        low = F.greatest(i + budget - fv.CHUNK_LOOKBACK, i + 1)
        kept = F.length(
            F.regexp_extract(text.substr(low + 1, end - low), "(?s)^(.*[\n ])", 1)
        )
        cut = F.when((end < n) & (kept > 0), low + kept).otherwise(end)
        follow = F.when(cut - overlap > i, cut - overlap).otherwise(cut)
        return F.when(acc["done"], acc).otherwise(
            F.struct(
                follow.alias("i"),
                (cut >= n).alias("done"),
                F.concat(
                    acc["out"], F.array(F.struct(i.alias("start"), cut.alias("cut")))
                ).alias("out"),
            )
        )

    windows = F.aggregate(steps, start, step, lambda acc: acc["out"])
    cut_up = F.transform(
        windows,
        lambda w: F.struct(
            w["start"].alias("start"),
            text.substr(w["start"] + 1, w["cut"] - w["start"]).alias("chunk"),
        ),
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("chunk")))
    return F.when(n <= budget, whole).otherwise(cut_up)
