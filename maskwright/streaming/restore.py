"""Restoring a stream of text deltas in which a replacement may be cut in two.

State per scope, many scopes to a page and many pages to a group: its map, sent once; per block the text
that cannot be decided yet (less than the longest replacement); per block or stream the next expected
sequence number and what came early.  Order of arrival does not matter; sequence numbers do.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from zlib import crc32
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.bodies import delta_patch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Groups that the scopes of a stream are dealt over; part of the state's key, so fixed.
BUCKETS = 4096
# Pages that the scopes of a group are dealt over in its state; fixed for the same reason.
PAGES = 8
FRAME_ROWS = 10000
# A map is looked for by one search per replacement up to this many replacements times characters.
SEARCHED = 10_000_000
ITEM = ["scope", "stream_id", "lane", "block", "seq", "kind", "delta", "payload"]
EVENT = "struct<type:string,index:int,delta:struct<type:string,text:string>>"
OUTPUT = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_stop", T.BooleanType()),
    T.StructField("complete", T.BooleanType()),
])
EVENTS_OUT = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("block", T.IntegerType()),
    T.StructField("payload", T.StringType()),
    T.StructField("complete", T.BooleanType()),
])


def use_rocksdb(spark: SparkSession, bounded_run: bool = False) -> None:
    """Stateful processors need the RocksDB state store.

    A ``bounded_run`` (trigger ``availableNow``) ends with the data; otherwise
    batches without data go on running so that idle timers can fire.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not bounded_run).lower())


def delta_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Text deltas and block stops of JSON events ``(stream_id, seq, payload)``.

    Returns ``(stream_id, block, seq, delta, is_stop)``; ``seq`` must number the
    text deltas and the stop of a block from 0 without holes.
    """
    e = F.from_json(F.col(payload), EVENT)
    return events.withColumn("_e", e).where(_is_text_event("_e")).select(
        F.col("stream_id").cast("string").alias("stream_id"),
        F.coalesce("_e.index", F.lit(0)).alias("block"),
        F.col("seq").cast("long").alias("seq"),
        F.col("_e.delta.text").alias("delta"),
        (F.col("_e.type") == "content_block_stop").alias("is_stop"),
    )


def other_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """All other events, unchanged, for passing on."""
    e = F.from_json(F.col(payload), EVENT)
    return events.withColumn("_e", e).where(~_is_text_event("_e")).drop("_e")


def _is_text_event(name: str):
    text = (F.col(f"{name}.type") == "content_block_delta") & (
        F.col(f"{name}.delta.type") == "text_delta"
    ) & F.col(f"{name}.delta.text").isNotNull()
    return F.coalesce(text | (F.col(f"{name}.type") == "content_block_stop"), F.lit(False))


class Finder:
    """Finds replacements from left to right, the longest first where several begin together.

    Most maps are small and met once a batch, so compiling a pattern costs far more than
    searching for each replacement; long texts with large maps get the pattern.
    """

    def __init__(self, fakes: list[str]):
        self.fakes, self.pattern = fakes, None

    def spans(self, text: str) -> list[tuple[int, int]]:
        if len(self.fakes) * len(text) > SEARCHED:
            if self.pattern is None:
                self.pattern = re.compile("|".join(map(re.escape, self.fakes)))
            return [match.span() for match in self.pattern.finditer(text)]
        hits = []
        for fake in self.fakes:
            at = text.find(fake)
            while at >= 0:
                hits.append((at, -len(fake)))
                at = text.find(fake, at + 1)
        hits.sort()
        found, end = [], 0
        for at, length in hits:
            if at >= end:
                end = at - length
                found.append((at, end))
        return found


def decide_all(
    buffer: str, ends: list[int], mapping: dict, finder: Finder | None, longest: int, flush: bool
) -> tuple[list[str], str]:
    """Restored texts that become certain as the buffer grows to each of ``ends``, and the raw rest.

    A position is certain when the longest replacement would fit behind it; with
    ``flush`` all is certain at the last end.
    """
    spans, k, done, texts = finder.spans(buffer) if finder else [], 0, 0, []
    for i, end in enumerate(ends, 1):
        all_certain = flush and i == len(ends)
        last, out = end if all_certain else end - longest, []
        while k < len(spans) and spans[k][0] <= last:
            start, stop = spans[k]
            out += [buffer[done:start], mapping[buffer[start:stop]]]
            done, k = stop, k + 1
        upto = end if all_certain else min(max(done, last + 1), end)
        out.append(buffer[done:upto])
        done = upto
        texts.append("".join(out))
    return texts, buffer[done:]


def decide(buffer: str, mapping: dict, finder: Finder | None, longest: int, flush: bool) -> tuple[str, str]:
    """Restored text that is certain by now, and the raw rest."""
    (text,), rest = decide_all(buffer, [len(buffer)], mapping, finder, longest, flush)
    return text, rest


def compile_mapping(text: str | None) -> tuple[dict, Finder | None, int]:
    mapping = {k: v for k, v in json.loads(text or "{}").items() if k}
    fakes = sorted(mapping, key=lambda f: (-len(f), f))
    return mapping, Finder(fakes) if fakes else None, len(fakes[0]) if fakes else 0


def delta_event(block: int, text: str) -> str:
    return json.dumps({"type": "content_block_delta", "index": block,
                       "delta": {"type": "text_delta", "text": text}}, ensure_ascii=False)


def page_of(scope: str) -> int:
    return crc32(scope.encode("utf-8", "surrogatepass")) % PAGES


class _Restorer(StatefulProcessor):
    """Restores the streams of the scopes of a bucket; their maps lie in its state.

    Scopes are small and many, and a call to the state costs more than the work of a
    scope, so the scopes of a group share a few pages of its state, each read and
    written once a batch; everything in a page is kept by scope.
    Items of a lane (a block, or with ``per_event`` a whole stream) are taken in the
    order of their numbers.  With ``per_event`` every event gives rows of its own.
    """

    def __init__(self, idle_ms: int, per_event: bool):
        self.idle_ms, self.per_event = idle_ms, per_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Maps of a page's scopes, as JSON in JSON, so that only those in use are parsed.
        self.maps = handle.getMapState("maps", "page int", "scopes string")
        # By scope when something last came for it, and its open lanes: stream, lane, next
        # number, what waits (numbers) and the blocks' undecided texts.
        self.scopes = handle.getMapState("scopes", "page int", "scopes string")
        self.early = handle.getMapState(
            "early", "scope string, stream_id string, lane int, seq long",
            "block int, kind string, delta string, payload string")
        # Lanes that ended, and when; a page goes when nothing ended in it for the idle time.
        self.closed = handle.getMapState("closed", "page int", "lanes string", self.idle_ms)
        # The maps given to a group at its start, while its first rows are read.
        self.given: tuple = None, {}

    @staticmethod
    def _read(state, page: int) -> dict:
        found = state.getValue((page,))
        return json.loads(found[0]) if found else {}

    @staticmethod
    def _write(state, page: int, held) -> None:
        if held:
            state.updateValue((page,), (json.dumps(held, ensure_ascii=False),))
        else:
            state.removeKey((page,))

    def _open_lanes(self, held: dict) -> dict:
        """Next number, waiting numbers and undecided texts of a page's open lanes, by scope."""
        return {scope: (at, {(scope, stream, lane): (seq, set(waiting), dict(tails))
                             for stream, lane, seq, waiting, tails in lanes})
                for scope, (at, lanes) in held.items()}

    def _write_open(self, page: int, scopes: dict) -> None:
        self._write(self.scopes, page, {scope: [at, [
            [stream, lane, seq, sorted(waiting), sorted(tails.items())]
            for (_, stream, lane), (seq, waiting, tails) in sorted(lanes.items())]]
            for scope, (at, lanes) in scopes.items()})

    def _ended(self, page: int, now: int) -> dict:
        """Lanes of a page that ended within the idle time, and when."""
        found = self.closed.getValue((page,))
        return {(scope, stream, lane): at for scope, stream, lane, at in json.loads(found[0])
                if now < at + self.idle_ms} if found else {}

    def _write_ended(self, page: int, ended: dict) -> None:
        self._write(self.closed, page, [[*lane, at] for lane, at in ended.items()])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        pages = self.given[1] if self.given[0] == key else {}
        changed = set()
        for scope, pairs in zip(initialState["scope"], initialState["mapping"]):
            page = page_of(scope)
            pages.setdefault(page, {})[scope] = pairs
            changed.add(page)
        for page in changed:
            self._write(self.maps, page, pages[page])
        self.given = key, pages

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        scopes, late, learned = defaultdict(lambda: defaultdict(dict)), defaultdict(list), defaultdict(dict)
        for pdf in rows:
            for scope, stream, lane, block, seq, kind, delta, payload in zip(*(pdf[c].tolist() for c in ITEM)):
                fresh = scopes[scope]
                if kind == "map":
                    learned[scope][payload] = delta
                    continue
                lane = scope, stream, int(lane)
                item = int(block), kind, delta, payload
                seq = None if seq is None or seq != seq else int(seq)
                if seq is None or seq in fresh[lane]:
                    late[scope].append((lane, seq, item))
                else:
                    fresh[lane][seq] = item
        pages = defaultdict(list)
        for scope in scopes:
            pages[page_of(scope)].append(scope)
        given = self.given[1] if self.given[0] == key else {}
        self.given = None, {}
        now, out, any_open = timerValues.getCurrentProcessingTimeInMs(), [], False
        for page, members in pages.items():
            maps = given.pop(page, None) or self._read(self.maps, page)
            if news := [scope for scope in members if scope in learned]:
                for scope in news:
                    maps[scope] = json.dumps(json.loads(maps.get(scope) or "{}") | learned[scope], sort_keys=True)
                self._write(self.maps, page, maps)
            held = self._open_lanes(self._read(self.scopes, page))
            ended = self._ended(page, now)
            was_open, n_ended = bool(held), len(ended)
            for scope in members:
                fresh = scopes.pop(scope)
                _, lanes = held.get(scope, (now, {}))
                compiled = compile_mapping(maps.get(scope)) if fresh else None
                for lane, items in fresh.items():
                    out += self._advance(lane, items, late[scope], lanes, ended, compiled, now)
                if self.per_event:
                    out += [(lane, seq, 0, "late", item[0], item[3], False) for lane, seq, item in late[scope]]
                if lanes:
                    any_open = True
                    held[scope] = now, lanes
                else:
                    held.pop(scope, None)
            if held or was_open:
                self._write_open(page, held)
            if len(ended) > n_ended:
                self._write_ended(page, ended)
            if len(out) >= FRAME_ROWS:
                yield self._frame(out)
                out = []
        if any_open and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + self.idle_ms)
        if out:
            yield self._frame(out)

    def _advance(self, lane, items, late, lanes, ended, compiled, now) -> list[tuple]:
        """Rows of what has come in without a hole; the rest waits."""
        begin, waiting, tails = 0, set(), {}
        if lane in lanes:
            begin, waiting, tails = lanes[lane]
        elif lane in ended:
            late += [(lane, seq, item) for seq, item in items.items()]
            return []
        at = begin
        for seq in [seq for seq in items if seq < begin]:
            late.append((lane, seq, items.pop(seq)))
        done = []
        while True:
            if at in waiting:
                if at in items:
                    late.append((lane, at, items.pop(at)))
                done.append((at, *self.early.getValue((*lane, at))))
                self.early.removeKey((*lane, at))
                waiting.remove(at)
            elif at in items:
                done.append((at, *items.pop(at)))
            else:
                break
            at += 1
            if not self.per_event and done[-1][2] == "stop":
                break
        stopped = not self.per_event and done and done[-1][2] == "stop"
        for seq, item in items.items():
            if seq in waiting:
                late.append((lane, seq, item))
            elif not stopped:
                self.early.updateValue((*lane, seq), item)
                waiting.add(seq)
        out = self._restored(lane, done, tails, compiled)
        if stopped:
            self._forget(lane, waiting, lanes, ended, now)
        else:
            lanes[lane] = at, waiting, {block: raw for block, raw in tails.items() if raw}
        return out

    def _restored(self, lane, done, raw, compiled) -> list[tuple]:
        """Rows of items in order; ``raw``, the blocks' undecided texts, is brought up to date.

        The deltas of a block up to its flush are decided together: ``runs`` holds them
        and the rows that wait for what becomes certain with each.
        """
        out, runs = [], defaultdict(lambda: ([], []))

        def settled(block: int, extra: str | None, flush: bool) -> str:
            deltas, rows = runs.pop(block, ([], []))
            buffer, ends = raw.get(block, ""), []
            for delta in deltas:
                ends.append((ends[-1] if ends else len(buffer)) + len(delta))
            if flush:
                deltas.append(extra or "")
                ends.append((ends[-1] if ends else len(buffer)) + len(deltas[-1]))
            texts, raw[block] = decide_all("".join([buffer, *deltas]), ends, *compiled, flush)
            for (at, patch), text in zip(rows, texts):
                seq = out[at]
                out[at] = lane, seq, 0, "text", block, patch(text) if patch else text, True
            return texts[-1]

        for seq, block, kind, delta, payload in done:
            if kind == "text":
                patch = delta_patch(payload) if self.per_event else None
                if patch or not self.per_event:
                    deltas, rows = runs[block]
                    raw.setdefault(block, "")
                    deltas.append(delta or "")
                    rows.append((len(out), patch))
                    out.append(seq)
                    continue
                kind = "other"
            ends = [block] if kind == "stop" else sorted(raw) if kind == "end" else []
            part = 0
            for ended in ends:
                text = settled(ended, delta, True)
                if not self.per_event:
                    out.append((lane, seq, 0, kind, ended, text, True))
                elif text:
                    out.append((lane, seq, part, "text", ended, delta_event(ended, text), True))
                    part += 1
            if self.per_event and payload is not None:
                out.append((lane, seq, part, kind, block, payload, True))
        for block in list(runs):
            settled(block, None, False)
        return out

    def _forget(self, lane, waiting, lanes, ended, now: int) -> None:
        for seq in waiting:
            self.early.removeKey((*lane, seq))
        lanes.pop(lane, None)
        ended[lane] = now

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        if self.per_event:
            lanes, *columns = zip(*out)
            names = EVENTS_OUT.fieldNames()
            return pd.DataFrame(dict(zip(names, [[lane[1] for lane in lanes], *columns])), columns=names)
        rows: dict[tuple, list] = {}
        for lane, seq, _, kind, block, text, complete in out:
            row = rows.setdefault((lane, block), [seq, [], False, True])
            row[0] = seq
            row[1].append(text)
            row[2] |= kind != "text"
            row[3] &= complete
        return pd.DataFrame(
            [(lane[1], block, seq, "".join(texts), stop, complete)
             for (lane, block), (seq, texts, stop, complete) in rows.items() if stop or any(texts)],
            columns=OUTPUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Scopes that stay silent are flushed with what has arrived, and closed."""
        now, out, still = timerValues.getCurrentProcessingTimeInMs(), [], []
        for (page,), (text,) in list(self.scopes.iterator()):
            held = self._open_lanes(json.loads(text))
            silent = [scope for scope, (at, _) in held.items() if at + self.idle_ms <= now]
            if silent:
                maps, ended = self._read(self.maps, page), self._ended(page, now)
                for scope in silent:
                    _, lanes = held.pop(scope)
                    compiled = compile_mapping(maps.get(scope))
                    for lane, (seq, waiting, tails) in sorted(lanes.items()):
                        early = [(k, *self.early.getValue((*lane, k))) for k in sorted(waiting)]
                        flush = early[-1][0] + 1 if early else seq
                        end = (flush, 0, "end", None, None) if self.per_event else (flush, lane[2], "stop", None, None)
                        done = self._restored(lane, [*early, end], tails, compiled)
                        out += [(*row[:6], not early) for row in done]
                        self._forget(lane, waiting, {}, ended, now)
                self._write_open(page, held)
                self._write_ended(page, ended)
            still += [at for at, _ in held.values()]
            if len(out) >= FRAME_ROWS:
                yield self._frame(out)
                out = []
        if still:
            self.handle.registerTimer(min(still) + self.idle_ms)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def mapping_json(mapping: DataFrame) -> DataFrame:
    """One JSON map ``{fake: real}`` per scope.

    For scopes the size of a conversation: a stream needs its whole map at hand
    because its text is not known in advance.
    """
    held = mapping.where("fake is not null")
    return held.groupBy(F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fake", "real"))))).alias(
            "mapping"
        )
    )


def _restored_by_scope(rows: DataFrame, mapping: DataFrame, idle_seconds: int, per_event: bool) -> DataFrame:
    """Rows of every scope through one processor, which is given each scope's map once.

    A stored map is the processor's initial state; a map that is a stream itself adds
    its pairs as they arrive, before the events of the same batch.
    """
    initial, bucket = None, F.pmod(F.xxhash64("scope"), F.lit(BUCKETS)).cast("int")
    if mapping.isStreaming:
        none = {n: F.lit(None).cast(t) for n, t in rows.dtypes}
        rows = rows.unionByName(mapping.where("fake is not null").select(*[c.alias(n) for n, c in (none | {
            "scope": F.col("scope").cast("string"), "kind": F.lit("map"),
            "payload": F.col("fake"), "delta": F.col("real")}).items()]))
    else:
        initial = mapping_json(mapping).withColumn("bucket", bucket).groupBy("bucket")
    return rows.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        _Restorer(idle_seconds * 1000, per_event), EVENTS_OUT if per_event else OUTPUT,
        "append", "ProcessingTime", initial)


def restore_stream(
    events: DataFrame, mapping: DataFrame, idle_seconds: int = 600, scope: str = "stream_id"
) -> DataFrame:
    """Restore a streaming ``(stream_id, block, seq, delta, is_stop)`` table.

    ``mapping`` is ``(scope, real, fake)``, stored or itself a stream; ``scope`` names
    the event column it belongs to.  Emits ``(stream_id, block, seq, text, is_stop,
    complete)``; the texts of a block in order give exactly the batch result.
    Rows without a number, repeated ones and those after the end of a block are
    dropped; a null block is block 0.  A scope that stays silent for
    ``idle_seconds`` is flushed, with ``complete`` false where deltas are missing.
    """
    return _restored_by_scope(events.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope"),
        F.coalesce(F.col("stream_id").cast("string"), F.lit("")).alias("stream_id"),
        F.coalesce(F.col("block").cast("int"), F.lit(0)).alias("lane"),
        F.coalesce(F.col("block").cast("int"), F.lit(0)).alias("block"),
        F.col("seq").cast("long").alias("seq"),
        F.when(F.col("is_stop"), "stop").otherwise("text").alias("kind"),
        "delta", F.lit(None).cast("string").alias("payload"),
    ), mapping, idle_seconds, False)


def restore_events(
    events: DataFrame, mapping: DataFrame, idle_seconds: int = 600, scope: str = "stream_id",
    payload: str = "payload",
) -> DataFrame:
    """Restore the text deltas of a streaming ``(stream_id, seq, payload)`` and pass on the rest.

    ``seq`` numbers all events of a stream from 0 without holes.  Emits ``(stream_id,
    seq, part, kind, block, payload, complete)``; by ``seq`` and ``part`` the
    payloads are the events to send.  ``kind`` is

    - ``text``: a delta with the text that is certain by now (only that literal
      changes), or one put before a stop for the rest of a block's text;
    - ``stop``, ``end`` (the message's end, before which all blocks are flushed) and
      ``other`` (all other events, broken JSON and deltas that name a field twice
      included): unchanged; a null payload only takes its number;
    - ``late``: events whose number is null, came before or lies behind the idle
      flush; unchanged, not to be sent, there to be counted.

    An event waits for the ones before it.  A scope that stays silent for
    ``idle_seconds`` is flushed in order of the numbers, with ``complete`` false where
    some are missing.  A null ``stream_id`` counts as the empty one.
    """
    e = F.from_json(F.col(payload), EVENT)
    rows = events.withColumn("_e", e).withColumn("_text", _is_text_event("_e"))
    kind = F.when(F.col("_e.type") == "content_block_stop", "stop").when(
        F.col("_e.type") == "message_stop", "end").when(
        F.col("_text"), "text").otherwise("other")
    return _restored_by_scope(rows.select(
        F.coalesce(F.col(scope).cast("string"), F.lit("")).alias("scope"),
        F.coalesce(F.col("stream_id").cast("string"), F.lit("")).alias("stream_id"),
        F.lit(0).alias("lane"), F.coalesce("_e.index", F.lit(0)).alias("block"),
        F.col("seq").cast("long").alias("seq"), kind.alias("kind"),
        F.col("_e.delta.text").alias("delta"), F.col(payload).alias("payload"),
    ), mapping, idle_seconds, True)


def restore_deltas(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Batch form for stored deltas: one restored text per (stream, block).

    A block's text is one value in the result, so it is put together whole.
    """
    from ..plans.restore import restore

    whole = events.groupBy("stream_id", "block").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))),
                lambda e: e["delta"],
            ),
            "",
        ).alias("text")
    )
    return restore(whole, mapping, "stream_id", ["stream_id", "block"], "text", "restored")
