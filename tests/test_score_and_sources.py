import json

import pytest
from pyspark.sql import functions as F

from maskwright.operators import score as sc
from maskwright.sources.cases import read_eval_cases
from maskwright.sources.chat import request_fields
from maskwright.sources.files import read_text_docs, scrub_path, scrub_result_json, scrubbed_path
from maskwright.sources.mappings import (
    load_mapping, mapping_conflicts, mapping_documents, mapping_file_cols, read_mapping_files,
    recent_mappings, sanitize_source, save_mapping,
)
from maskwright.sources.runs import scrub_runs
from maskwright.plans.restore import longest_fake
from maskwright.plans.scrub import scrub

CASE = "id string, task string, pii array<string>, essential array<string>"
OUT = "strategy string, id string, scrubbed string, spans array<struct<text:string,scrubbed:boolean>>, error string"


def test_scores(spark):
    cases = spark.createDataFrame([
        ("c1", "x", ["Jola", "Kestrel", "Jola", "Turku"], ["Turku", "Turku"]),
        ("c2", None, [], []),
    ], CASE)
    outputs = spark.createDataFrame([
        ("s", "c1", "Jola at X in Y", [("Kestrel", True), ("Noise", True), ("Kept", False)], None),
        ("s", "c2", "text", [], None),
        ("t", "c1", None, None, "timeout"),
        ("t", "c2", "text", [], None),
    ], OUT)
    scores = sc.score_cases(cases, outputs)
    got = {(r.strategy, r.id): r for r in scores.collect()}
    r = got["s", "c1"]
    assert (r.recall, r.leaks, r.over_scrubbed, r.extra_scrubbed, r.n_pii) == (
        0.333, ["Jola", "Jola"], ["Turku"], ["Noise"], 3)
    assert got["s", "c2"].recall == 1.0 and got["s", "c2"].task == "?"
    r = got["t", "c1"]
    assert (r.recall, r.leaks, r.over_scrubbed, r.n_pii) == (0.0, ["<error>"], [], 4)
    ranked = sc.rank_strategies(sc.score_strategies(scores)).orderBy("rank").collect()
    assert [(r.strategy, r.total_leaks, r.mean_recall) for r in ranked] == [("t", 1, 0.5), ("s", 2, 0.666)]
    notes = {r.id: r.notes for r in sc.case_report(scores).where("strategy = 's'").collect()}
    assert notes == {"c1": "LEAK:Jola,Jola; over:Turku", "c2": ""}


def test_cases_and_cache(spark, tmp_path):
    lines = [{"id": "a", "text": "t", "pii": [], "essential": []},
             {"id": "b", "text": "u", "pii": ["u"], "essential": [], "split": "holdout"}]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, lines)))
    path = str(tmp_path / "cases.jsonl")
    assert [r.id for r in read_eval_cases(spark, path, "dev").collect()] == ["a"]
    assert read_eval_cases(spark, path).count() == 2
    keyed = read_eval_cases(spark, path).withColumn(
        "cache_key", sc.cache_key(F.lit("v"), F.lit("s"), F.col("text")))
    left = sc.missing_results(keyed, keyed.where("id = 'a'"))
    assert [r.id for r in left.collect()] == ["b"]


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_text("mail a@b.co")
    (tmp_path / "in" / "noext").write_text("call 718-555-0164")
    (tmp_path / "in" / "odd.xyz").write_text("fine")
    (tmp_path / "in" / "bin.xyz").write_bytes(b"ab\0cd")
    docs = read_text_docs(spark, str(tmp_path / "in"))
    assert sorted((r.path.split("/")[-1], r.ext, r.error or "") for r in docs.collect()) == [
        ("a.TXT", "txt", ""), ("bin.xyz", "xyz", "binary"), ("noext", "txt", ""), ("odd.xyz", "xyz", "")]
    counts = scrub_path(spark, str(tmp_path / "in"), str(tmp_path / "out"), contextual=None)
    got = {r.out_path.split("/")[-1]: r.n_scrubbed for r in counts.collect()}
    assert {k: got[k] for k in got if not k.startswith("bin")} == {
        "a.scrubbed.txt": 1, "noext.scrubbed.txt": 1, "odd.scrubbed.xyz": 0}
    assert spark.read.parquet(str(tmp_path / "out" / "mappings")).count() == 2


def test_paths(spark):
    df = spark.createDataFrame([("/x/a.b.md", "md"), ("c.pdf", "pdf"), ("/x/.env", "txt")], "p string, e string")
    assert [r[0] for r in df.select(scrubbed_path(F.col("p"), F.col("e"))).collect()] == [
        "/x/a.b.scrubbed.md", "c.scrubbed.txt", "/x/.env.scrubbed.txt"]


def test_result_json(spark):
    done = scrub(spark.createDataFrame([("d", "a@b.co")], "i string, text string"), contextual=None)
    result = json.loads(scrub_result_json(done, ["i"]).first().result)
    assert result["mapping"] == {result["scrubbed"]: "a@b.co"}
    assert result["spans"][0]["category"] == "email"


def test_mapping_store(spark, tmp_path):
    mapping = spark.createDataFrame(
        [("s", "Jola", "Avery"), ("s", "Bob", "Quinn"), ("t", "Jola", "Sage")],
        "scope string, real string, fake string")
    documents = mapping_documents(mapping)
    assert {r.scope: r.value for r in documents.collect()}["s"] == '{"Avery":"Jola","Quinn":"Bob"}'
    back = load_mapping(documents).select("scope", "real", "fake")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mapping.collect()))
    broken = load_mapping(spark.createDataFrame([("x", "nope")], "scope string, value string"))
    assert [r.error for r in broken.collect()] == ["not a JSON object"]
    assert mapping_conflicts(mapping).count() == 0
    assert mapping_conflicts(mapping.union(mapping.limit(1))).count() == 2
    assert {r.scope: r.longest for r in longest_fake(mapping).collect()} == {"s": 5, "t": 4}
    save_mapping(mapping, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1700000000-my_doc.map.json").write_text('{"Avery": "Jola"}')
    row = read_mapping_files(spark, str(tmp_path / "f")).first()
    assert (row.source_name, row.fake, row.real) == ("my_doc", "Avery", "Jola")


def test_mapping_names(spark):
    files = spark.createDataFrame(
        [("1700000000-my_doc.map.json",), ("x-.map.json",), ("nodash.map.json",), ("1-a.json",)],
        "file_name string")
    got = recent_mappings(mapping_file_cols(files), 1).collect()
    assert [r.source_name for r in got] == ["my_doc"]
    assert {r.source_name for r in mapping_file_cols(files).collect()} == {"my_doc", "document"}
    names = spark.createDataFrame([("a b.c.txt",), ("é" * 50,), ("",)], "n string")
    assert [r[0] for r in names.select(sanitize_source(F.col("n"))).collect()] == [
        "a_b_c", "_" * 40, "document"]


def test_requests(spark):
    body = json.dumps({"system": "sys [x]", "messages": [
        {"role": "user", "content": "hi"},
        {"role": "user", "content": [
            {"type": "text", "text": "t1"}, {"type": "tool_use", "input": {"text": "no"}},
            {"type": "tool_result", "content": "plain"},
            {"type": "tool_result", "content": [{"type": "text", "text": "deep"}]},
            {"type": "text", "text": " \n "}]}]})
    df = spark.createDataFrame([(1, body), (2, "broken")], "id int, body string")
    rows = request_fields(df, "id").orderBy("id", "ord").collect()
    assert [r.text for r in rows if r.id == 1] == ["sys [x]", "hi", "t1", "plain", "deep"]
    assert [r.error for r in rows if r.id == 2] == ["body is not a JSON object"]


@pytest.mark.parametrize("cuts", [(3, 9), (1, 2), (12, 20)])
def test_runs(spark, cuts):
    text = "Ask Jola Whitfield now."
    i, j = cuts
    runs = spark.createDataFrame(
        [("p", "doc", 0, 1, text[i:j]), ("p", "doc", 0, 0, text[:i]), ("p", "doc", 0, 2, text[j:]),
         ("p", "doc", 1, 0, "Jola"), ("q", "doc", 0, 0, "Jola")],
        "path string, part string, para int, run int, text string")
    mapping = spark.createDataFrame(
        [("p", "Jola Whitfield", "Avery Hartley"), ("p", "Jola", "Quinn")],
        "scope string, real string, fake string")
    got = {(r.path, r.para, r.run): r.text for r in scrub_runs(runs, mapping).collect()}
    assert got == {("p", 0, 0): "Ask Avery Hartley now.", ("p", 0, 1): "", ("p", 0, 2): "",
                   ("p", 1, 0): "Quinn", ("q", 0, 0): "Jola"}


def test_file_that_is_no_utf8_gives_an_error_row(spark, tmp_path):
    (tmp_path / "good.txt").write_text("mail ann@x-corp.io", encoding="utf-8")
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 \xff")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in read_text_docs(spark, str(tmp_path)).collect()}
    assert rows["good.txt"].text == "mail ann@x-corp.io" and rows["good.txt"].error is None
    assert rows["bad.txt"].text is None and rows["bad.txt"].error == "not UTF-8"
    out = tmp_path / "out"
    (tmp_path / "in").mkdir()
    for name in ("good.txt", "bad.txt"):
        (tmp_path / name).rename(tmp_path / "in" / name)
    assert scrub_path(spark, str(tmp_path / "in"), str(out)).count() == 2
    texts = {r.error: r.scrubbed for r in spark.read.parquet(f"{out}/texts").collect()}
    assert "ann@" not in texts[None] and "not UTF-8" in texts
