"""Chat requests with typed content parts as one formatted text and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Marks of the template; escaped text holds neither "<" nor "[".
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"

PART = ("struct<type:string,text:string,media:string,width:int,height:int,seconds:double,pages:int>")
_BLOCK = ("struct<type:string,text:string,content:string,"
          "source:struct<type:string,media_type:string,url:string,file_id:string>,"
          "width:int,height:int,seconds:double,pages:int>")


RESULT_DEPTH = 4


def escape(text: Column) -> Column:
    """Text without any control string; :func:`unescape` gives it back."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A plain string as the one part of a message."""
    return F.array(F.from_json(F.lit("{}"), PART).withField("type", F.lit("text"))
                   .withField("text", F.coalesce(text, F.lit(""))))


def content_parts(content: Column, depth: int = RESULT_DEPTH) -> Column:
    """Parts of a request's ``content``: a plain string, or a JSON list of blocks.

    Blocks are ``text``, ``image``, ``audio`` and ``document`` with a ``source``, and
    ``tool_result``, whose content is again a string or a list of blocks; its parts come in
    its place, up to ``depth`` results within each other.  What is no list of blocks
    is text.
    """
    def one(b: Column) -> Column:
        result = b["type"] == "tool_result"
        part = F.array(F.struct(
            F.when(result, "text").otherwise(b["type"]).alias("type"),
            F.when(result, b["content"]).otherwise(b["text"]).alias("text"),
            F.coalesce(b["source"]["url"], b["source"]["file_id"], b["source"]["media_type"]).alias("media"),
            b["width"].alias("width"), b["height"].alias("height"), b["seconds"].alias("seconds"),
            b["pages"].alias("pages")).cast(PART))
        if depth:
            part = F.when(result & F.ltrim(b["content"]).startswith("["),
                          content_parts(b["content"], depth - 1)).otherwise(part)
        return part

    def listed(blocks: Column) -> Column:
        whole = blocks.isNotNull() & F.forall(blocks, lambda b: b.isNotNull() & b["type"].isNotNull())
        return F.when(whole, F.flatten(F.transform(blocks, one)))

    is_list = F.coalesce(F.ltrim(content).startswith("["), F.lit(False))
    blocks = F.when(is_list, F.from_json(content, f"array<{_BLOCK}>"))
    return F.coalesce(F.get(F.transform(F.array(blocks), listed), F.lit(0)), text_part(content))


def _tokens(part: Column, pixels: int, per_second: int, per_page: int) -> Column:
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) * F.coalesce(part["height"], F.lit(0)) / pixels)
    return (F.when(part["type"] == "image", F.greatest(image, F.lit(1)))
            .when(part["type"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second), F.lit(1)))
            .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * per_page)
            .otherwise(0).cast("long"))


def format_chats(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", parts: str = "parts", speaker: str = "assistant",
                 pixels: int = 750, per_second: int = 25, per_page: int = 1500) -> DataFrame:
    """Every conversation as one text, with the spans that a loss is taken on.

    ``messages`` are those of chat requests, one row per turn: conversation, turn,
    role and content parts (:func:`content_parts`, :func:`text_part`).  A visitor
    goes through the parts in order: text is escaped and kept, an image, audio or
    document part becomes a placeholder ``[type k]`` and an attachment ``k`` of its
    turn, with its reference and the tokens it will expand to (at least one: images
    by ``pixels`` per token, audio by second, documents by page).

    Returns per conversation ``n_turns``, ``formatted``, ``loss_spans`` (code points
    ``start, length`` of each ``speaker`` turn's body), ``attachments`` (``turn_index,
    ordinal, type, media, tokens``) and ``expanded_tokens``.  Null texts, roles and
    part lists are empty; a part of unknown or null type is kept as its text; null
    conversations form one; turns with equal numbers follow each other by role and
    content, repeated rows included; an empty table gives no rows.  Native only.  A
    conversation is one row of the result, so it must fit one; its turns are
    formatted before they are brought together.
    """
    kinds = ("image", "audio", "document")
    visited = F.aggregate(
        F.coalesce(parts, F.from_json(F.lit("[]"), f"array<{PART}>")),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("n"),
                 F.from_json(F.lit("[]"), "array<struct<ordinal:int,type:string,media:string,tokens:bigint>>")
                 .alias("attachments")),
        lambda acc, x: F.when(
            x["type"].isin(*kinds),
            F.struct(
                F.concat(acc["text"], F.lit("["), x["type"], F.lit(" "), (acc["n"] + 1).cast("string"), F.lit("]")).alias("text"),
                (acc["n"] + 1).alias("n"),
                F.concat(acc["attachments"], F.array(F.struct(
                    (acc["n"] + 1).alias("ordinal"), x["type"].alias("type"), x["media"].alias("media"),
                    _tokens(x, pixels, per_second, per_page).alias("tokens")))).alias("attachments"),
            )).otherwise(F.struct(
                F.concat(acc["text"], escape(F.coalesce(x["text"], F.lit("")))).alias("text"),
                acc["n"].alias("n"), acc["attachments"].alias("attachments"))))
    rows = messages.select(
        F.col(conversation).alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(role, F.lit("")).alias("_role"), visited.alias("_seen"))
    rows = rows.select(
        "_conv", "_turn", "_role", F.col("_seen.text").alias("_body"),
        F.col("_seen.attachments").alias("_attachments"),
        F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(SAYS)).alias("_head"))
    in_order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_body")
    length = F.length("_head") + F.length("_body") + len(END)
    rows = rows.withColumn("_index", F.row_number().over(in_order)).withColumn(
        "_start", (F.sum(length).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - length)
        .cast("long"))
    one = F.struct(
        F.col("_index").alias("i"), F.concat("_head", "_body", F.lit(END)).alias("text"),
        F.when(F.col("_role") == speaker, F.struct(
            (F.col("_start") + F.length("_head")).alias("start"),
            F.length("_body").cast("long").alias("length"))).alias("loss"),
        F.col("_attachments").alias("attachments"))
    chats = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
        (t["i"] - 1).alias("turn_index"), a["ordinal"].alias("ordinal"), a["type"].alias("type"),
        a["media"].alias("media"), a["tokens"].alias("tokens")))))
    return chats.select(
        F.col("_conv").alias(conversation), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted conversation; placeholders
    of attachments stay."""
    pieces = F.filter(F.split(formatted, "<\\|end\\|>"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 2147483647), SAYS, 1)).alias("role"),
        unescape(F.substring_index(x, SAYS, -1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    # Four bytes per code point: a span is cut out without counting from the start.
    both = F.array(F.struct(F.encode(formatted, "UTF-32").alias("wide"), spans.alias("spans")))
    cut = F.get(F.transform(both, lambda b: F.array_join(F.transform(
        b["spans"], lambda s: F.decode(F.substring(b["wide"], (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32")), "")),
        F.lit(0))
    return unescape(cut)
