"""Chat requests: the texts in them, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.detect import explode_in_order

REQUEST = "struct<system:variant,messages:array<struct<role:string,content:variant>>>"
BLOCKS = "array<struct<type:string,text:string,content:variant>>"
INNER = "array<struct<type:string,text:string>>"
# Tool results within tool results that are listed; deeper ones are refused when a body is rewritten.
RESULT_DEPTH = 4
FIELD = "array<struct<path:string,text:string>>"


def chat_fields(turns: DataFrame, text: str = "text") -> DataFrame:
    """Turns whose text is not blank; the order is the turns' own."""
    return turns.where(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) > 0)


def _fields(content: Column, path: Column, types: bool, depth: int) -> Column:
    """Fields of a content value: a string, or text and tool-result blocks."""
    none = F.array().cast(FIELD)
    one = F.array(F.struct(path.alias("path"), F.try_variant_get(content, "$", "string").alias("text")))
    as_blocks = F.try_variant_get(content, "$", BLOCKS if depth else INNER)

    def block(b: Column, i: Column) -> Column:
        at = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        text = F.array(F.struct(F.concat(at, F.lit(".text")).alias("path"), b["text"].alias("text")))
        is_text = b["text"].isNotNull()
        if types:
            is_text = is_text & (b["type"] == "text")
        out = F.when(is_text, text)
        if depth:
            out = out.when(
                b["type"] == "tool_result",
                _fields(b["content"], F.concat(at, F.lit(".content")), types, depth - 1),
            )
        return out.otherwise(none)

    kind = F.schema_of_variant(content)
    return (
        F.when(kind == "STRING", one)
        .when(kind.startswith("ARRAY"), F.flatten(F.transform(as_blocks, block)))
        .otherwise(none)
    )


def request_fields(requests: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Texts of chat requests held as JSON: ``key, ord, path, text, error``.

    The system prompt first, then the messages; tool results may hold blocks of
    their own; tool input stays out.  A body that is no JSON object gives one
    row with ``error`` instead of passing unchecked.
    """
    parsed = F.from_json(F.col(body), REQUEST)
    rows = requests.select(key, F.col(body).alias("_b"), parsed.alias("_r"))
    ok = F.try_parse_json("_b").isNotNull() & F.schema_of_variant(
        F.try_parse_json("_b")).startswith("OBJECT")
    broken = rows.where(~F.coalesce(ok, F.lit(False))).select(
        key, F.lit(0).alias("ord"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("string").alias("text"), F.lit("body is not a JSON object").alias("error"),
    )
    good = rows.where(F.coalesce(ok, F.lit(False)))
    none = F.array().cast(FIELD)
    system = F.coalesce(_fields(F.col("_r.system"), F.lit("system"), False, 0), none)
    messages = F.flatten(F.transform(
        F.coalesce("_r.messages", F.array().cast("array<struct<role:string,content:variant>>")),
        lambda m, i: F.coalesce(
            _fields(
                m["content"],
                F.concat(F.lit("messages["), i.cast("string"), F.lit("].content")), True, RESULT_DEPTH,
            ),
            none,
        ),
    ))
    fields = good.select(key, F.concat(system, messages).alias("_f"))
    out = explode_in_order(fields, "_f", "ord", "_e").select(
        key, "ord", "_e.path", "_e.text", F.lit(None).cast("string").alias("error")
    )
    return chat_fields(out).unionByName(broken)
