"""Chat requests scrubbed and replies restored, as whole JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.finder import Model
from ..sources.bodies import patch_bodies
from ..sources.chat import request_fields
from ..storage import cut_lineage
from .restore import restore
from .scoped import Scrubbed, scrub_scoped

REPLY = "struct<content:array<struct<type:string,text:string>>>"


def _patched(bodies: DataFrame, texts: DataFrame, key: str, body: str, kind: str, complete: bool) -> DataFrame:
    """Bodies with ``_new``; the texts ``key, path, text`` of a body meet in its row."""
    lists = texts.groupBy(F.col(key).alias("_key")).agg(
        F.collect_list(F.struct("path", "text")).alias("_texts"))
    held = bodies.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left")
    return held.withColumn("_new", patch_bodies(F.col(body), F.col("_texts"), kind, complete))


def scrub_requests(
    requests: DataFrame, key: str = "request_id", body: str = "body",
    contextual: str | Model | None = "rules", **options,
) -> Scrubbed:
    """Scrub chat requests held as JSON bodies; all texts of a request share one map.

    ``requests`` is ``(request_id, body)`` with one row per id.  Texts are the system
    prompt, messages and tool results at any depth; tool input stays as it is, and so
    does every byte outside the texts.  ``options`` are those of ``scrub_scoped``.

    ``texts`` of the result are the rows of ``requests`` with ``scrubbed``, the new body,
    and ``error``.  A body that cannot be read or that holds a text the
    finder did not see is null with an ``error``: nothing passes unchecked.
    """
    fields = cut_lineage(request_fields(requests, key, body), "request-fields")
    good = fields.where("error is null").select(key, "ord", "path", "text")
    done = scrub_scoped(good, key, ["ord"], "text", contextual, **options)
    new = done.texts.select(key, "path", F.col("scrubbed").alias("text"))
    names = [c for c in requests.columns if c not in ("scrubbed", "error")]
    out = _patched(requests.select(*names), new, key, body, "request", True)
    return done._replace(texts=out.select(
        *names, F.col("_new.body").alias("scrubbed"),
        F.when(F.col(body).isNull(), F.lit("no body")).otherwise(F.col("_new.error")).alias("error")))


def restore_replies(
    replies: DataFrame, mapping: DataFrame, key: str = "request_id", body: str = "body",
    where: Column | None = None,
) -> DataFrame:
    """Add ``restored``: JSON replies with the real values of their request back in.

    ``replies`` is ``(request_id, body)`` with one row per id, ``mapping`` the map
    ``(scope, real, fake)`` whose scope is the request's id.  Only text blocks change, and
    only where ``where`` holds (say, ``status = 200``); other replies, bodies
    that are no JSON object and null bodies stay as they are.
    """
    names = [c for c in replies.columns if c != "restored"]
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = replies.select(*names).withColumn("_ok", ok)
    blocks = F.from_json(F.col(body), REPLY)["content"]
    texts = rows.where("_ok").select(key, F.posexplode(blocks).alias("ord", "_b"))
    texts = texts.where("_b.type = 'text' and _b.text <> ''").select(
        key, "ord", F.concat(F.lit("content["), F.col("ord").cast("string"), F.lit("].text")).alias("path"),
        F.col("_b.text").alias("text"))
    back = restore(cut_lineage(texts, "reply-texts"), mapping, key, [key, "ord"], "text")
    out = _patched(rows, back.select(key, "path", F.col("restored").alias("text")), key, body, "reply", False)
    return out.select(*names, F.when(F.col("_ok"), F.coalesce("_new.body", F.col(body)))
                      .otherwise(F.col(body)).alias("restored"))
