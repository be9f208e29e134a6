"""Request and reply bodies, models over shared scopes, whole tables, stored results and maps."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskwright.operators.finder import answer_key, chunk_documents, find_spans
from maskwright.operators import tabular
from maskwright.operators.tabular import scrub_table
from maskwright.plans.chats import restore_replies, scrub_requests
from maskwright.plans.scoped import scrub_conversations, scrub_dataset
from maskwright.plans.scrub import scrub
from maskwright.sources.bodies import patched_body, reply_places, request_places
from maskwright.sources.files import read_text_docs
from maskwright.sources.mappings import load_scope, load_scopes, save_mapping
from maskwright.sources.results import cached_results
from maskwright.storage import checkpoint_dir


def nested(depth, text):
    """A message content with tool results within each other."""
    content = text
    for _ in range(depth):
        content = [{"type": "tool_result", "content": content}]
    return content


def test_patch_keeps_every_other_byte():
    body = ' {"n": 1.50e+3 ,"system":"a\\u0062c", "messages":[{"role":"u","content":[ {"text":"x","type":"text"},' \
           '{"type":"tool_use","input":{"text":"x"}},{"content":"y","type":"tool_result"} ]}],"z":[1,{"text":"x"}]} '
    texts = {"system": "new \n\"é", "messages[0].content[0].text": "X", "messages[0].content[2].content": "y"}
    got = patched_body(body, texts, request_places, True)
    want = body.replace('"a\\u0062c"', '"new \\n\\"é"').replace('[ {"text":"x"', '[ {"text":"X"')
    assert got == want and json.loads(got)["z"] == [1, {"text": "x"}]
    with pytest.raises(ValueError):
        patched_body('{"system": "left"}', {}, request_places, True)
    with pytest.raises(ValueError):
        patched_body('{"system": "a", "system": "b"}', {"system": "c"}, request_places, True)
    reply = '{"content":[{"type":"text","text":"F"},{"type":"thinking","text":"F"}],"text":"F"}'
    assert patched_body(reply, {"content[0].text": "R"}, reply_places, False) == reply.replace('"F"', '"R"', 1)


def test_scrub_requests_refuse_what_they_cannot_check(spark):
    mail = "jola@corp-mail.org"
    bodies = {
        "plain": json.dumps({"system": f"I am {mail}", "messages": [
            {"role": "user", "content": nested(3, f"deep {mail}")}, {"role": "user", "content": [
                {"type": "text", "text": mail}, {"type": "tool_use", "input": {"to": mail}}, {"type": "text", "text": " "}]}]}),
        "blocks": json.dumps({"system": [{"type": "text", "text": f"[{mail}]"}], "messages": []}),
        "deeper": json.dumps({"messages": [{"role": "user", "content": nested(9, mail)}]}),
        "broken": '{"system": "' + mail, "list": "[1]", "empty": "{}", "none": None,
        "odd": json.dumps({"system": 5, "messages": [{"role": "user"}, 7, {"content": {"text": mail}}]}),
    }
    df = spark.createDataFrame(list(bodies.items()), "request_id string, body string").withColumn("error", F.lit("old"))
    done = scrub_requests(df, contextual=None)
    got = {r.request_id: r for r in done.texts.collect()}
    fake = {r.scope: r.fake for r in done.mapping.collect()}
    assert json.loads(got["plain"].scrubbed) == json.loads(
        bodies["plain"].replace(mail, fake["plain"]).replace(f'"to": "{fake["plain"]}"', f'"to": "{mail}"'))
    assert got["blocks"].scrubbed == bodies["blocks"].replace(mail, fake["blocks"])
    assert got["empty"].scrubbed == "{}" and got["odd"].scrubbed == bodies["odd"]
    for key in ("deeper", "broken", "list", "none"):
        assert got[key].scrubbed is None and got[key].error, key
    assert all(got[k].error is None for k in ("plain", "blocks", "empty", "odd"))


def test_restore_replies_by_status(spark):
    mapping = spark.createDataFrame(
        [("a", "Jola Whitfield", "Avery Hartley"), ("a", "Jola", "Avery"), ("b", "Bob", "Quinn")],
        "scope string, real string, fake string")
    body = '{"content": [{"type":"text","text":"Ask Avery Hartley, Avery"},{"type":"tool_use","input":{"who":"Avery"}}], "n":1.0}'
    rows = [("a", body, 200), ("b", body.replace("Avery", "Quinn"), 500), ("c", body, 200), ("d", "oops", 200), ("e", None, 200)]
    df = spark.createDataFrame(rows, "request_id string, body string, status int")
    got = {r.request_id: r.restored for r in restore_replies(df, mapping, where=F.col("status") == 200).collect()}
    assert got["a"] == body.replace("Ask Avery Hartley, Avery", "Ask Jola Whitfield, Jola")
    assert [got[k] for k in "bcde"] == [r[1] for r in rows[1:]]
    assert restore_replies(df.limit(0), mapping).count() == 0


def model():
    """A stand-in that is sent to the workers by value."""
    def says(prompts: pd.Series, instructions: str, max_tokens: int) -> pd.Series:
        def one(p):
            if "refuse" in p:
                raise ValueError("refused")
            return "\n".join(
                f"{w} | person | {'yes' if 'keep' in p else 'no'}" for w in ("Jola", "Whitfield") if w in p)
        return prompts.map(one)
    return says


def test_one_verdict_per_value_and_conversation(spark):
    rows = [(1, 0, "keep Jola"), (1, 1, "Jola and Whitfield"), (1, 2, "refuse Jola, mail jola@corp-mail.org"),
            (2, 0, "Jola first"), (2, 1, "keep Jola now"), (3, 0, None), (3, 1, "")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, text string")
    done = scrub_conversations(turns, contextual=model(), strategy="baseline")
    texts = {(r.conv_id, r.turn): r for r in done.texts.collect()}
    spans = {(r.scope, r.text): r for r in done.spans.collect()}
    assert spans["1", "Jola"].essential and not spans["1", "Jola"].scrubbed and spans["1", "Jola"].fake == "Jola"
    assert not spans["2", "Jola"].essential and spans["1", "jola@corp-mail.org"].source == "regex"
    assert "Jola" in texts[1, 1].scrubbed and "Whitfield" not in texts[1, 1].scrubbed
    assert "Jola" not in texts[2, 1].scrubbed and "corp-mail" not in texts[1, 2].scrubbed
    assert [len(texts[k].warnings) for k in ((1, 0), (1, 2), (3, 1))] == [0, 1, 0] and texts[3, 0].scrubbed is None
    assert {(r.scope, r.real) for r in done.mapping.collect()} == {
        ("1", "Whitfield"), ("1", "jola@corp-mail.org"), ("2", "Jola")}
    one = scrub_dataset(turns.withColumn("doc_id", F.col("conv_id") * 10 + F.col("turn")), contextual=model(), strategy="baseline")
    assert {r.text: r.essential for r in one.spans.collect() if r.source == "model"} == {"Jola": True, "Whitfield": False}


def test_stored_answers_stand_in_for_a_model(spark):
    docs = spark.createDataFrame([(1, "Jola met Whitfield. " * 400), (2, "Whitfield"), (3, "unknown Jola"), (4, None)],
                                 "doc_id int, text string")
    chunks = chunk_documents(docs.where("doc_id < 3"))
    answers = chunks.select(answer_key("baseline", F.col("chunk")).alias("cache_key"),
                            F.lit("Jola | person | no\nWhitfield | org | no").alias("raw"), F.lit(None).cast("string").alias("error"))
    got = {r.doc_id: r for r in find_spans(docs, answers.union(answers), strategy="baseline").collect()}
    n = chunks.where("doc_id = 1").count()
    assert len(got[1].model_spans) == 2 * n and [s.text for s in got[2].model_spans] == ["Whitfield"]
    assert len(got[3].warnings) == 1 and "no stored answer" in got[3].warnings[0] and got[4].model_spans == []
    done = {r.doc_id: r.scrubbed for r in scrub(docs, contextual=answers, strategy="baseline").collect()}
    assert "Whitfield" not in done[2] and done[3] == "unknown Jola"


@pytest.mark.parametrize("share", [1 / 4096, 1.0, 0.0])
def test_table_in_one_pass(spark, monkeypatch, share):
    monkeypatch.setattr(tabular, "HOT_SHARE", share)
    rows = [(i, "Dana Whitfield" if i % 3 else f"Person {i}", f"mail p{i % 5}@corp-mail.org or 10.9.8.{i % 4}"
             if i % 7 else None, "ann@corp-mail.org" if i % 2 else " ", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, full_name string, remark string, user_email string, score double")
    done, mapping = scrub_table(df)
    put = {r.real: r.fake for r in mapping.collect()}
    kinds = {r.real: r.kind for r in mapping.collect()}
    assert len(set(put.values())) == len(put) and kinds["ann@corp-mail.org"] == "email" and kinds["10.9.8.1"] == "ip_address"
    for old, new in zip(rows, done.orderBy("id").collect()):
        assert new.full_name == put[old[1]] and new.score == old[4] and new.id == old[0]
        want = old[2]
        for real in sorted(put, key=len, reverse=True):
            want = want.replace(real, put[real]) if want and old[2] and real in old[2] else want
        assert new.remark == want and new.user_email == (put[old[3]] if old[3].strip() else old[3])
    plain = df.select("id", "score")
    assert scrub_table(plain)[0].orderBy("id").collect() == plain.orderBy("id").collect()
    kept, more = scrub_table(df.limit(3), existing=spark.createDataFrame(
        [("table", "Dana Whitfield", "Old Name")], "scope string, real string, fake string"))
    assert {r.full_name for r in kept.collect()} >= {"Old Name"}
    assert scrub_table(df, scan=[])[0].where("remark like '%corp-mail%'").count() > 0


def test_table_is_joined_once(spark):
    df = spark.range(50).select("id", *[F.concat(F.lit(f"v{k} "), F.col("id")).alias(f"name_{k}") for k in range(5)])
    done, _ = scrub_table(df, overrides={f"name_{k}": "person" for k in range(5)})
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    # The table's rows with their maps, hot values, the other values, and those that are hot.
    assert plan.count("name_4#") and sum("Join" in line for line in plan.splitlines()) == 4


def test_results_are_scored_once(spark):
    path = f"{checkpoint_dir(spark)}/results-test-{id(spark)}-{pd.Timestamp.now().value}"
    schema = "cache_key string, n int, run int"
    seen = []

    def produce(run):
        def score(rows):
            seen.append(sorted(r.cache_key for r in rows.collect()))
            return rows.select("cache_key", F.length("text").alias("n"), F.lit(run).alias("run"))
        return score

    rows = spark.createDataFrame([("a", "x"), ("b", "xx"), ("b", "xx"), ("c", "xxx")], "cache_key string, text string")
    first = cached_results(rows.where("cache_key <> 'c'"), path, schema, produce(1))
    assert first.count() == 3
    both = cached_results(rows, path, schema, produce(2)).collect()
    assert seen == [["a", "b"], ["c"]] and sorted((r.cache_key, r.n, r.run) for r in both) == [
        ("a", 1, 1), ("b", 2, 1), ("b", 2, 1), ("c", 3, 2)]


def test_one_scope_is_read_from_its_folder(spark, tmp_path):
    rows = [(str(i), f"real {i}", f"fake {i}") for i in range(500)]
    save_mapping(spark.createDataFrame(rows, "scope string, real string, fake string"), str(tmp_path / "m"), 16)
    one = load_scope(spark, str(tmp_path / "m"), "77", 16)
    assert [tuple(r) for r in one.select("scope", "real", "fake").collect()] == [rows[77]]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert load_scopes(spark, str(tmp_path / "m")).count() == 500


def test_refused_files_have_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.dat").write_bytes(b"x\0y")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.log9").write_text("text all the same")
    rows = {r.path[-5:]: (r.text, r.error) for r in read_text_docs(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("plain", None), "b.dat": (None, "binary"), "c.pdf": (None, "needs a text extractor"),
                    ".log9": ("text all the same", None)}


def test_texts_with_one_key_share_a_map(spark):
    rows = [(1, "mail ada@x.com now"), (1, "mail ada@x.com or bob@y.org"), (1, "mail ada@x.com now"), (2, "bob@y.org")]
    done = scrub_dataset(spark.createDataFrame(rows, "doc_id long, text string"), csv=False)
    fakes = {r.real: r.fake for r in done.mapping.collect()}
    want = []
    for key, text in rows:
        for real, fake in fakes.items():
            text = text.replace(real, fake)
        want.append((key, text))
    assert sorted((r.doc_id, r.scrubbed) for r in done.texts.collect()) == sorted(want) and len(fakes) == 2
