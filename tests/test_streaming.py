import itertools
import json
import random
import time

from pyspark.sql import functions as F

from maskwright.plans.scrub import scrub
from maskwright.sources.bodies import delta_place, patched_body, patched_delta
from maskwright.streaming import restore as streams
from maskwright.streaming.restore import (
    compile_mapping, decide, delta_events, other_events, restore_deltas, restore_events, restore_stream,
    use_rocksdb,
)
from maskwright.streaming.scrub import scrub_conversation_stream

MAPPING = [("s1", "Noora", "Avery"), ("s1", "Jola Whitfield", "Avery Hartley"),
           ("s1", "Avery", "Avery 2"), ("s1", "Avery Hartley", "Quinn")]
TEXT = "Ask Avery Hartley and Avery 2, then Quinn, Avery."
WANT = "Ask Jola Whitfield and Avery, then Avery Hartley, Noora."
EVENTS = "stream_id string, block int, seq long, delta string, is_stop boolean"


def test_every_cut():
    mapping, pattern, longest = compile_mapping(
        '{"Avery": "Noora", "Avery Hartley": "Jola Whitfield", "Avery 2": "Avery", "Quinn": "Avery Hartley"}')
    for i, j in itertools.combinations_with_replacement(range(len(TEXT) + 1), 2):
        out, rest = "", ""
        for part in (TEXT[:i], TEXT[i:j], TEXT[j:]):
            text, rest = decide(rest + part, mapping, pattern, longest, False)
            assert len(rest) < longest
            out += text
        assert out + decide(rest, mapping, pattern, longest, True)[0] == WANT


def run(spark, frame, name, tmp_path, mode="append"):
    use_rocksdb(spark, bounded_run=True)
    query = (frame.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for block, (i, j) in enumerate([(5, 12), (9, 30), (1, 2)]):
        parts = [TEXT[:i], TEXT[i:j], TEXT[j:]]
        rows += [("s1", block, k, p, False) for k, p in enumerate(parts)]
        rows.append(("s1", block, 3, None, True))
    rows.append(("other", 0, 0, "Avery stays", False))
    rows.append(("other", 0, 1, None, True))
    random.Random(3).shuffle(rows)
    source = str(tmp_path / "in")
    for at in range(0, len(rows), 7):
        spark.createDataFrame(rows[at:at + 7], EVENTS).coalesce(1).write.mode("append").parquet(source)
    mapping = spark.createDataFrame(MAPPING, "scope string, real string, fake string")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    out = run(spark, restore_stream(stream, mapping), "restored", tmp_path)
    got = {(r.stream_id, r.block): r.t for r in out.groupBy("stream_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))),
                                 lambda x: x["text"]), "").alias("t")).collect()}
    batch = {(r.stream_id, r.block): r.restored
             for r in restore_deltas(spark.read.parquet(source), mapping).collect()}
    assert got == batch
    assert batch == {("s1", b): WANT for b in range(3)} | {("other", 0): "Avery stays"}


def test_events(spark):
    df = spark.createDataFrame([
        ("s", 0, '{"type":"message_start"}'),
        ("s", 1, '{"type":"content_block_delta","index":2,"delta":{"type":"text_delta","text":"hi"}}'),
        ("s", 2, '{"type":"content_block_delta","index":2,"delta":{"type":"input_json_delta"}}'),
        ("s", 3, '{"type":"content_block_stop","index":2}'),
        ("s", 4, "not json"),
    ], "stream_id string, seq long, payload string")
    assert [tuple(r) for r in delta_events(df).collect()] == [
        ("s", 2, 1, "hi", False), ("s", 2, 3, None, True)]
    assert [r.seq for r in other_events(df).collect()] == [0, 2, 4]


def test_streamed_scrub(spark, tmp_path):
    schema = "conv_id string, turn int, text string"
    source = str(tmp_path / "turns")
    turns = [("a", 0, "my manager Jola wrote from jola@x.com"), ("a", 1, "jola@x.com again, Jola"),
             ("b", 0, "jola@x.com")]
    for i, t in enumerate(turns):
        spark.createDataFrame([t], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    texts = run(spark, scrub(stream, contextual=None).select("text", "scrubbed"), "texts", tmp_path)
    assert texts.where("scrubbed like '%jola@x.com%'").count() == 0 and texts.count() == 3
    chats = run(spark, scrub_conversation_stream(stream, contextual=None), "chats", tmp_path)
    got = {(r.conv_id, r.turn): r.scrubbed for r in chats.collect()}
    assert len(got) == 3 and not [t for t in got.values() if "jola@x.com" in t]
    assert got["a", 1].split(" ")[0] == got["a", 0].split(" ")[-1]


def delta(text, block=0, spaced=False):
    event = {"type": "content_block_delta", "index": block, "delta": {"type": "text_delta", "text": text}}
    return json.dumps(event, indent=1 if spaced else None)


def event_rows():
    """Two blocks that alternate, other events between them, and a stream that ends without a stop."""
    stop = json.dumps({"type": "content_block_stop", "index": 0})
    twice = '{"type":"content_block_delta","delta":{"type":"text_delta","text":"Avery","text":"Quinn"}}'
    s1 = ['{"type":"message_start"}', delta(TEXT[:5]), delta(TEXT[:9], 1), "not json", delta(TEXT[5:30], 0, True),
          None, delta(TEXT[9:], 1), twice, delta(TEXT[30:]), stop, delta("Quinn", 0), '{"type":"message_stop"}', "last"]
    s2 = [delta("Avery Hart"), delta("ley"), '{"type":"message_stop"}']
    return [("s1", k, p) for k, p in enumerate(s1)] + [("s2", k, p) for k, p in enumerate(s2)], s1


def test_event_stream_keeps_order(spark, tmp_path):
    rows, s1 = event_rows()
    rows += [("s1", 1, "again"), ("s1", None, "no number"), (None, 0, delta("Avery"))]
    late = {("s1", 1), ("s1", None)}
    first, rest = rows[:4], rows[4:]
    random.Random(5).shuffle(rest)
    schema, source = "stream_id string, seq long, payload string", str(tmp_path / "in")
    for part in [first] + [rest[i:i + 3] for i in range(0, len(rest), 3)]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    pairs = spark.createDataFrame(MAPPING + [("s2", *p[1:]) for p in MAPPING], "scope string, real string, fake string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = run(spark, restore_events(stream, pairs), "events", tmp_path).collect()
    assert {(r.stream_id, r.seq) for r in out if r.kind == "late"} == late
    sent = sorted((r for r in out if r.kind != "late"), key=lambda r: (r.stream_id, r.seq, r.part))
    assert len({(r.stream_id, r.seq, r.part) for r in sent}) == len(sent)
    texts = {}
    for r in sent:
        if r.kind == "text":
            event = json.loads(r.payload)
            key = r.stream_id, event["index"]
            texts[key] = texts.get(key, "") + event["delta"]["text"]
    assert texts == {("s1", 0): WANT + "Avery Hartley", ("s1", 1): WANT, ("s2", 0): "Jola Whitfield", ("", 0): "Avery"}
    assert [r.payload for r in sent if r.stream_id == "s1" and r.kind != "text"] == [
        s1[k] for k in (0, 3, 7, 9, 11, 12)]
    assert [r.seq for r in sent if r.stream_id == "s1" and r.part == 0] == [k for k in range(13) if k != 5]
    spaced = next(r for r in sent if r.stream_id == "s1" and r.seq == 4)
    assert "\n" in spaced.payload  # only the literal changes


def test_map_is_sent_once(spark, tmp_path):
    pairs = spark.createDataFrame(MAPPING, "scope string, real string, fake string")
    frame = spark.createDataFrame([], EVENTS)
    frame.write.parquet(str(tmp_path / "none"))
    stream = restore_stream(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "none")), pairs)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_maps_that_arrive_and_silence(spark, tmp_path):
    """A streamed map; a scope that falls silent is flushed, holes and all."""
    use_rocksdb(spark)
    maps, source = str(tmp_path / "maps"), str(tmp_path / "in")
    schema = "stream_id string, seq long, payload string"
    spark.createDataFrame(MAPPING, "scope string, real string, fake string").coalesce(1).write.parquet(maps)
    rows = [("s1", 0, delta("Ask Ave")), ("s1", 1, delta("ry")), ("s1", 3, "behind a hole"), ("x", 0, delta("Avery"))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    pairs = spark.readStream.schema("scope string, real string, fake string").parquet(maps)
    stream = spark.readStream.schema(schema).parquet(source)
    query = (restore_events(stream, pairs, idle_seconds=2).writeStream.format("memory").queryName("silent")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start())
    try:
        until = time.time() + 120
        while time.time() < until and spark.table("silent").where("not complete").isEmpty():
            time.sleep(1)
        got = sorted((r for r in spark.table("silent").collect()), key=lambda r: (r.stream_id, r.seq, r.part))
    finally:
        query.stop()
    text = "".join(json.loads(r.payload)["delta"]["text"] for r in got if r.kind == "text" and r.stream_id == "s1")
    assert text == "Ask Noora"
    assert [(r.payload, r.complete) for r in got if r.kind == "other"] == [("behind a hole", False)]


def test_scopes_of_a_group_stay_apart(spark, tmp_path, monkeypatch):
    """Many scopes share a group; a stream's name may occur in several of them."""
    monkeypatch.setattr(streams, "BUCKETS", 1)
    schema, source = "owner string, " + EVENTS, str(tmp_path / "in")
    rows = [(o, "s", 0, k, t, t is None) for o in "abc" for k, t in enumerate(["Ask Ave", "ry now", None])]
    for at in range(3):
        part = [r for r in rows if r[3] == (at + 1) % 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    pairs = spark.createDataFrame([(o, f"Noora{o}", "Avery") for o in "ab"], "scope string, real string, fake string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = run(spark, restore_stream(stream, pairs, scope="owner"), "apart", tmp_path).collect()
    assert sorted(r.text for r in out if r.is_stop) == ["Ask Avery now", "Ask Nooraa now", "Ask Noorab now"]


def test_plain_deltas_are_patched_like_others():
    for text in ("a", 'q"\\', "\u00e9\n", ""):
        event = {"type": "content_block_delta", "index": 3, "delta": {"type": "text_delta", "text": text}}
        plain = json.dumps(event, separators=(",", ":"))
        for new in (text, "new \u00e9"):
            want = patched_body(plain, {"delta.text": new}, delta_place, False)
            assert patched_delta(plain, lambda: new) == want
            assert json.loads(patched_delta(json.dumps(event, indent=1), lambda: new))["delta"]["text"] == new
    assert patched_delta('{"type":"content_block_delta","delta":{"text":"a","text":"b"}}', lambda: "x") is None
