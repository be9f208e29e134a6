import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators.rewrite import make_pairs, rewrite
from maskwright.plans.restore import restore, restore_text, split_payload
from maskwright.plans.scoped import scrub_conversations, scrub_dataset
from maskwright.plans.scrub import mapping_table, scrub, span_table

HARD = ["ann@x-corp.io", "718-555-0164", "517-24-8306", "4539 1488 0343 6467",
        "sk_live_7hTq2LmX90bZ", "db1.internal.corp", "192.168.1.20"]


def by_id(df, *columns):
    return {r.i: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
            for r in df.collect()}


@pytest.mark.parametrize("text,pairs,whole,expected", [
    ("Jola at Jolacorp, Jola.", [("Jola", "X")], True, "X at Jolacorp, X."),
    ("a $1 \\E x", [("\\E", "$2\\"), ("$1", "q")], True, "a q $2\\ x"),
    ("Avery and Avery Mercer", [("Avery", "Avery Mercer"), ("Avery Mercer", "Quinn")], True,
     "Avery Mercer and Quinn"),
    ("aXa", [("X", "y")], True, "aXa"),
    ("aXa", [("X", "y")], False, "aya"),
    ("éJola", [("Jola", "X")], True, "éX"),
    ("none", [], True, "none"),
    ("", [("a", "b")], True, ""),
])
def test_rewrite(spark, text, pairs, whole, expected):
    df = spark.createDataFrame(
        [(text, [f for f, _ in pairs], [p for _, p in pairs])], "t string, f array<string>, p array<string>"
    ).withColumn("pairs", make_pairs(F.col("f"), F.col("p")))
    assert df.select(rewrite(F.col("t"), F.col("pairs"), whole)).first()[0] == expected


def test_hard_ids_never_survive(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(60):
        picked = rnd.sample(HARD, rnd.randint(0, len(HARD)))
        rows.append((i, " then ".join(["start"] + picked + ["end"]), picked))
    df = spark.createDataFrame(rows, "i int, text string, picked array<string>")
    done = scrub(df, contextual=None)
    for r in done.collect():
        assert not [p for p in r.picked if p in r.scrubbed]
        assert len(set(r.mapping)) == len(set(r.mapping.values())) == len(r.picked)
        assert [s.source for s in r.spans] == ["regex"] * len(r.picked)
    back = done.where(restore_text(F.col("scrubbed"), F.col("mapping")) != F.col("text"))
    assert back.count() == 0


def test_csv_text(spark):
    text = ("Display Name,User Name,Title\r\nAnn Lee,ann.lee@corp.com,Developer\r\n"
            "\"Ray, Bob\",bob@corp.com,Designer\r\nAnn Lee,zed@corp.com,Developer")
    row = scrub(spark.createDataFrame([(0, text)], "i int, text string")).first()
    got = [(s.text, s.category, s.source) for s in row.spans]
    assert got == [("ann.lee@corp.com", "email", "regex"), ("bob@corp.com", "email", "regex"),
                   ("zed@corp.com", "email", "regex"), ("Ann Lee", "person_name", "csv"),
                   ("Ray, Bob", "person_name", "csv")]
    assert "Developer" in row.scrubbed and "Ann Lee" not in row.scrubbed


def test_essential_spans_stay(spark):
    def model(prompts, instructions, max_tokens):
        return prompts.map(lambda p: "Lisbon | city | yes\nIrene Vasko | person | no\na@b.co | other | yes")

    text = "Is Lisbon warm? Irene Vasko, a@b.co, asks about Lisbon."
    row = scrub(spark.createDataFrame([(text,)], "text string"), contextual=model,
                strategy="baseline").first()
    assert row.scrubbed.count("Lisbon") == 2
    assert "Irene" not in row.scrubbed and "a@b.co" not in row.scrubbed
    kept = [(s.text, s.fake, s.scrubbed) for s in row.spans if s.essential]
    assert kept == [("Lisbon", "Lisbon", False)]


def test_adjacent_identifiers_restore(spark):
    ids = [f"{100 + i % 500}-{10 + i % 80}-{1000 + 7 * i}" for i in range(300)]
    texts = [(i, f"ids {a} {ids[-1 - i]} end") for i, a in enumerate(ids)]
    done = scrub(spark.createDataFrame(texts, "i long, text string"), contextual=None)
    back = done.withColumn("back", restore_text(F.col("scrubbed"), F.col("mapping")))
    assert back.where("back <> text").count() == 0


def test_second_look_leaves_own_fakes(spark):
    df = spark.createDataFrame([(h,) for h in HARD], "text string")
    rows = scrub(df, contextual=None).collect()
    assert all(len(r.spans) == 1 for r in rows)


def test_scrub_has_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = scrub(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 2


def test_span_and_mapping_tables(spark):
    df = spark.createDataFrame([("d1", "a@b.co and 10.1.2.3"), ("d2", "none")], "i string, text string")
    done = scrub(df, contextual=None)
    assert span_table(done, ["i"]).count() == 2
    assert {(r.scope, r.real) for r in mapping_table(done, "i").collect()} == {
        ("d1", "a@b.co"), ("d1", "10.1.2.3")}


TURNS = [
    ("a", 0, "system", "Be nice to my manager Jola. Mail jola@x.com or 10.1.2.3"),
    ("a", 1, "user", "Jola said (718) 555-0164 is ok; Jolacorp not, jola@x.com"),
    ("a", 2, "user", "  "),
    ("b", 0, "user", "Name,Phone,Org\nAnn Lee,718-555-0164,Norvik Inc"),
    ("b", 1, "user", "Bob Ray,718-555-0165,Norvik Inc\n"),
    ("c", 0, "user", "nothing here"),
]


def test_conversations_share_a_map(spark):
    df = spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string")
    done = scrub_conversations(df)
    rows = sorted(map(tuple, done.texts.collect()))
    for inline in (200, 0):
        back = restore(done.texts, done.mapping, "conv_id", ["turn"], inline=inline)
        assert back.where("restored <> text").count() == 0
    text = {(r[0], r[1]): r[4] for r in rows}
    fake = {(r.scope, r.real): r.fake for r in done.mapping.collect()}
    assert text["a", 1].startswith(fake["a", "Jola"] + " said")
    assert text["b", 1] == f"{fake['b', 'Bob Ray']},{fake['b', '718-555-0165']},{fake['b', 'Norvik Inc']}\n"
    assert ("b", "Name") not in fake
    assert {r.source for r in done.spans.where("scope = 'b'").collect()} == {"regex", "csv"}


def test_hot_scope(spark):
    """One conversation holds most texts and values; every text gets its own pairs only."""
    df = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.concat(F.lit("mail u"), (F.col("id") % 300).cast("string"), F.lit("@x.org and u"),
                 ((F.col("id") + 7) % 300).cast("string"), F.lit("@x.org.")).alias("text"))
    done = scrub_conversations(df, contextual=None, csv=False)
    fake = {(r.scope, r.real): r.fake for r in done.mapping.collect()}
    for r in done.texts.collect():
        a, b = (fake[str(r.conv_id), f"u{n % 300}@x.org"] for n in (r.turn, r.turn + 7))
        assert r.scrubbed == f"mail {a} and {b}."


def test_adjacent_identifiers_restore_from_a_shared_map(spark):
    ids = [f"{100 + i % 500}-{10 + i % 80}-{1000 + 7 * i}" for i in range(300)]
    texts = [(i, i % 7, f"ids {a} {ids[-1 - i]} end") for i, a in enumerate(ids)]
    df = spark.createDataFrame(texts, "turn long, conv_id long, text string")
    for done, scope in ((scrub_conversations(df, contextual=None), "conv_id"),
                        (scrub_dataset(df, "turn"), None)):
        back = restore(done.texts, done.mapping, scope, ["turn"])
        assert back.count() == 300 and back.where("restored <> text").count() == 0
        by = (F.lit("all") if scope is None else F.col(scope).cast("string")).alias("scope")
        claimed = done.spans.where("scrubbed").withColumnRenamed("text", "real")
        left = done.texts.select(by, "scrubbed").alias("t").join(claimed.alias("s"), "scope").where(
            F.col("t.scrubbed").contains(F.col("s.real")))
        assert left.count() == 0


def test_dataset_routes_every_text_alone(spark):
    prose = "The quarterly report is fine, nothing private."
    people = "Name,City,Role\nIngrid Solheim,Bergen,Cook\nPaavo Rinne,Oulu,Baker\nIda Moe,Voss,Cook"
    for texts in ([prose, people], [people, prose]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = {r.text: r.scrubbed for r in scrub_dataset(df).texts.collect()}
        assert got[prose] == prose
        assert not [n for n in ("Ingrid Solheim", "Paavo Rinne", "Ida Moe") if n in got[people]]
        assert got[people].startswith("Name,City,Role\n")


def test_dataset_scope_goes_on_with_a_map(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "c@d.co a@b.co")], "doc_id int, text string")
    old = spark.createDataFrame([("all", "a@b.co", "old@example.com")],
                                "scope string, real string, fake string")
    got = {r.doc_id: r.scrubbed for r in scrub_dataset(df, existing=old).texts.collect()}
    assert got[1] == "old@example.com"
    assert got[2].endswith(" old@example.com") and "c@d.co" not in got[2]


def test_payload(spark):
    mapping = {"Avery": "Noora", "Avery Hartley": "Jola Whitfield", "Avery 2": "Avery",
               "Quinn": "Avery Hartley"}
    payload = json.dumps(mapping) + "\n---\nAsk Avery Hartley and Avery 2, then Quinn, Avery."
    df = spark.createDataFrame([(payload,), ("no separator",), ("[]\n---\nx",)], "p string")
    rows = df.select(split_payload(F.col("p")).alias("x")).select(
        "x.error", restore_text(F.col("x.text"), F.col("x.mapping")).alias("t")).collect()
    assert rows[0].t == "Ask Jola Whitfield and Avery, then Avery Hartley, Noora."
    assert rows[1].error == "no separator" and rows[2].error is not None


def test_large_map_is_probed(spark):
    """A map of 100,000 pairs: only texts that hold a stand-in are joined, wherever it starts."""
    from maskwright.operators.occur import attach_stand_ins

    n = 100_000
    long = "x" * 70
    pairs = spark.range(n).select(
        F.lit("all").alias("scope"), F.concat(F.lit("real"), "id").alias("real"),
        F.when(F.col("id") % 1000 == 0, F.concat(F.lit(long), "id")).when(F.col("id") % 3 == 0, F.concat(F.lit("Åsa😀 "), "id"))
        .otherwise(F.concat(F.lit("Avery "), "id")).alias("fake"))
    mapping = {r.fake: r.real for r in pairs.collect()}
    texts = [f"Avery said {i} things, Åsa😀 too" for i in range(300)]
    texts += [f"notAvery {i * 31 % n}0 and Åsa😀 {i * 3}!" for i in range(100)]
    texts += [None, "", "Avery 4", long + "5000" + long, "a" * 300_000 + "Avery 7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, scrubbed string").withColumn("lead", F.lit(1))
    got = {r.doc_id: r.restored for r in restore(df, pairs, None, ["doc_id"]).collect()}
    longest = max(map(len, mapping))

    def want(text):
        out, at = "", 0
        while at < len(text):
            found = next((text[at:at + k] for k in range(min(longest, len(text) - at), 0, -1)
                          if text[at:at + k] in mapping), None) if text[at] in "AÅx" else None
            out += mapping[found] if found else text[at]
            at += len(found) if found else 1
        return out

    assert got == {i: None if t is None else want(t) for i, t in enumerate(texts)}
    rows = df.withColumn("scope", F.lit("all"))
    held = attach_stand_ins(rows, pairs.select("scope", F.col("fake").alias("find"), F.col("real").alias("put")),
                            ["doc_id"], "scrubbed").collect()
    assert all(r.pairs is None for r in held if r.doc_id < 300)
    assert all(r.pairs for r in held if r.doc_id > 401)


def test_probe_finds_windows_across_pieces(monkeypatch):
    import numpy as np
    from maskwright.operators import occur

    monkeypatch.setattr(occur, "PIECE", 7)
    scope, other = 0x5BD1E9955BD1E995, 0x27D4EB2F165667C5  # scopes come hashed
    text, words = "the quick brown fox jumps over the lazy dog" * 3, np.zeros(1 << 10, np.uint64)
    for lead in ("quick brown", "g", "dogthe"):
        for _, _, both in occur.Probe(16, [len(lead)]).places(lead, scope):
            for p in both:
                words[int(p[0]) >> 6] |= np.uint64(1) << np.uint64(int(p[0]) & 63)
    probe = occur.Probe(16, [1, 6, 11])
    assert set(probe.found(text, scope, words)) == {"quick brown", "g", "dogthe"}
    assert not probe.found(text, other, words)
