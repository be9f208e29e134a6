"""Scrubbing chat turns as they arrive, one growing map per conversation.

Single texts need no state: ``plans.scrub.scrub`` works on a streaming table as
it is.  Here the map of a conversation is state; detection and rewriting stay
native expressions around it.  A turn can only use what earlier turns and the
turn itself revealed.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.bind import _bind_one_row
from ..operators.candidates import rule_spans
from ..operators.detect import detect_hits
from ..operators.rewrite import make_pairs, rewrite


class _MapKeeper(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pairs = handle.getMapState("pairs", "real string", "fake string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        known = {k[0]: v[0] for k, v in self.pairs.iterator()}
        used = set(known.values())
        for pdf in rows:
            finds, puts = [], []
            for text, real, kind in zip(pdf["text"], pdf["mw_real"], pdf["mw_kind"]):
                new = [(r, k) for r, k in zip(real, kind) if r not in known]
                barred = set(known) | {r for r, _ in new}
                fakes = _bind_one_row([r for r, _ in new], [k for _, k in new], used, barred)
                for (r, _), f in zip(new, fakes):
                    known[r] = f
                    self.pairs.updateValue((r,), (f,))
                here = [r for r in known if r in text]
                finds.append(here)
                puts.append([known[r] for r in here])
            yield pdf[self.columns].assign(mw_find=finds, mw_put=puts)

    def close(self) -> None:
        pass


def scrub_conversation_stream(
    turns: DataFrame, conversation: str = "conv_id", text: str = "text",
    contextual: str | None = "rules",
) -> DataFrame:
    """Add ``scrubbed`` to a streaming table of chat turns."""
    t = F.col(text)
    hits = F.transform(
        detect_hits(t), lambda h: F.struct(h["value"].alias("v"), h["kind"].alias("k"))
    )
    if contextual == "rules":
        hits = F.concat(hits, F.transform(
            rule_spans(t), lambda s: F.struct(s["text"].alias("v"), s["kind"].alias("k"))
        ))
    given = turns.columns
    found = turns.withColumn("_all", hits).withColumn("_txt", t).select(
        *given, F.transform("_all", lambda h: h["v"]).alias("mw_real"),
        F.transform("_all", lambda h: h["k"]).alias("mw_kind"),
    ).withColumnRenamed(text, "text")
    columns = [c if c != text else "text" for c in given]
    strings = T.ArrayType(T.StringType())
    schema = T.StructType(
        [f for f in found.schema.fields if f.name in columns]
        + [T.StructField("mw_find", strings), T.StructField("mw_put", strings)]
    )
    kept = found.groupBy(conversation).transformWithStateInPandas(
        _MapKeeper(columns), schema, "append", "None"
    )
    done = rewrite(F.col("text"), make_pairs(F.col("mw_find"), F.col("mw_put")))
    return kept.withColumn("scrubbed", done).withColumnRenamed("text", text).select(
        *given, "scrubbed"
    )
