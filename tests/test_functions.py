import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fixed_values as fv
from maskwright.functions.hashing import fnv1a64, hash_hex
from maskwright.functions.synthetics import candidate, fake, stable_hash
from maskwright.functions.text import (
    chunk_text, csv_field_count, csv_fields, looks_like_csv, luhn_valid,
)
from maskwright.operators.spans import normalize_kind
from maskwright.operators.tabular import classify_header

GOLDEN = [
    ("email", "marta@example.net", 0, "phoenix83@example.com"),
    ("email", "marta@example.net", 7, "reese52@example.com"),
    ("email", "marta@example.net", 14, "emerson25@example.com"),
    ("person_name", "Marta Quillfeather", 0, "Avery Delgado"),
    ("person_name", "Marta Quillfeather", 7, "Emerson Ashford"),
    ("person_name", "Marta Quillfeather", 14, "Blair Calloway"),
    ("organization", "Orrin Foundry", 0, "Veraxis"),
    ("organization", "Orrin Foundry", 7, "Veraxis"),
    ("location", "Turku", 0, "Brookhaven"),
    ("location", "Turku", 7, "Fairmont"),
    ("project_or_product", "Peregrine", 0, "Project Verdant"),
    ("project_or_product", "Peregrine", 7, "Project Tessera"),
    ("other_sensitive", "Z81QP7LMND20", 0, "[redacted-8956]"),
    ("ssn", "517-24-8306", 0, "217-21-2167"),
    ("phone", "718-555-0164", 0, "(555) 989-8144"),
    ("credit_card", "4539 1488 0343 6467", 0, "2943 1084 3700 6718"),
    ("ip_address", "10.20.30.40", 0, "10.245.163.51"),
    ("api_key", "sk_live_4vTb81mWq0Zr", 0, "sk_live_3ab2db974755-12eb220e356f"),
    ("internal_host", "ledger-03.internal.corp", 0, "host-6f370bc5.internal.corp"),
]


def test_golden_fakes(spark):
    rows = [(k, r, n) for k, r, n, _ in GOLDEN]
    df = spark.createDataFrame(rows, "kind string, real string, nudge int")
    got = df.select(fake(F.col("kind"), F.col("real"), F.col("nudge"))).collect()
    assert [g[0] for g in got] == [g[3] for g in GOLDEN]
    assert [candidate(k, r, n) for k, r, n in rows] == [g[3] for g in GOLDEN]


def test_native_and_python_fakes_agree(spark):
    rnd = random.Random(5)
    alphabet = "abcXYZ 019-_.@éßŁ漢😀"
    kinds = fv.HARD_ID_KINDS + fv.CONTEXT_KINDS
    heads = ["", "sk-", "SK-ant-", "ghp_", "AKIA", "akia", "xoxb-", "xo", "pk_test_", "cus_", "Ab_"]
    rows = [
        (rnd.choice(kinds), rnd.choice(heads) + "".join(rnd.choices(alphabet, k=rnd.randint(0, 30))),
         rnd.choice([0, 1, 7, 350, 707]))
        for _ in range(600)
    ]
    df = spark.createDataFrame(rows, "kind string, real string, nudge int")
    got = df.select(fake(F.col("kind"), F.col("real"), F.col("nudge"))).collect()
    assert [g[0] for g in got] == [candidate(*r) for r in rows]


def test_hash(spark):
    values = ["a", "Noora", "", "Kraków", "日本"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(hash_hex(fnv1a64(F.col("s")))).collect()]
    assert got[:2] == ["af63dc4c8601ec8c", "3dea54d84e9b29b2"]
    assert got == [f"{stable_hash(v):016x}" for v in values]


def test_luhn(spark):
    df = spark.createDataFrame(
        [("4539 1488 0343 6467",), ("4539-1488-0343-6468",), ("411",), ("",)], "s string"
    )
    assert [r[0] for r in df.select(luhn_valid(F.col("s"))).collect()] == [True, False, False, False]


def test_fake_cards_pass_luhn(spark):
    df = spark.range(200).select(
        luhn_valid(fake(F.lit("credit_card"), F.col("id").cast("string"))).alias("ok"))
    assert df.where("not ok").count() == 0


@pytest.mark.parametrize("line,fields", [
    ('a,"b,c",d', ["a", "b,c", "d"]),
    ('a,"b""x,",d,', ["a", 'b"x,', "d", ""]),
    ('x"y,z"w,"open,1', ["xy,zw", "open,1"]),
    (",a,b", ["", "a", "b"]),
    ("", [""]),
    ('a,"",c', ["a", "", "c"]),
    ('a,"q""', ["a", 'q"']),
])
def test_csv_fields(spark, line, fields):
    row = spark.createDataFrame([(line,)], "l string").select(
        csv_fields(F.col("l")).alias("f"), csv_field_count(F.col("l")).alias("n")).first()
    assert (row.f, row.n) == (fields, len(fields))


def _csv_rows(good, bad):
    return "a,b,c\n" + "\n".join(["1,2,3"] * good + ["1,2"] * bad)


@pytest.mark.parametrize("text,expected", [
    ("a,b,c\r\n1,2,3\r\n4,5,6", True),
    ("\n\na,b,c\n\n1,2,3\n4,5,6\n", True),
    (_csv_rows(8, 2), True),
    (_csv_rows(79, 21), True),          # only the first 30 rows count
    (_csv_rows(7, 2), False),
    ("a,b\n1,2\n3,4", False),
    ("a,b,c\n1,2,3", False),
    ("Well, yes, no.\nThis line has one, comma.\nNone here", False),
    ("", False),
])
def test_looks_like_csv(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(looks_like_csv(F.col("t"))).first()[0] is expected


def brute_chunks(text, budget=3500, overlap=200):
    """Straight reading of the window rule, for comparison."""
    if len(text) <= budget:
        return [text]
    out, at = [], 0
    while True:
        end = min(at + budget, len(text))
        cut = end
        if end < len(text):
            tail = text[max(at + budget - 200, at + 1):end]
            keep = max(tail.rfind("\n"), tail.rfind(" "))
            if keep >= 0:
                cut = end - len(tail) + keep + 1
        out.append(text[at:cut])
        if cut >= len(text):
            return out
        at = cut - overlap if cut - overlap > at else cut


def test_chunks(spark):
    rnd = random.Random(2)
    texts = ["", "x" * 3500, "x" * 3501, "y" * 9000]
    texts += ["".join(rnd.choices("ab \n", weights=[9, 9, w, 1], k=n))
              for n, w in ((4000, 2), (7300, 0), (15000, 1))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [c.chunk for c in r.c]
           for r in df.select("i", chunk_text(F.col("t")).alias("c")).collect()}
    assert got == {i: brute_chunks(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("header,kind", [
    ("Display Name", "person"), ("User Name", "identifier"), ("Title", "skip"),
    ("Device Name", "identifier"), ("Serial Number", "identifier"), ("Organization", "organization"),
    ("contact_name", "person"), ("org-name", "organization"), ("mail", "identifier"),
    ("work mail", "identifier"), ("org", "organization"), ("account", "organization"),
    ("Department", "skip"), ("hotel", "identifier"), ("capacity", "location"), ("User", "person"),
    ("c_name", "person"), (" name ", "person"), ("", "skip"),
])
def test_headers(spark, header, kind):
    df = spark.createDataFrame([(header,)], "h string")
    assert df.select(classify_header(F.col("h"))).first()[0] == kind


def test_kind_labels(spark):
    labels = [("PERSON_NAME", "person_name"), ("full name", "person_name"),
              ("Job-Title", "job_title"), ("spouse", "relationship"), ("??", "other_sensitive")]
    df = spark.createDataFrame(labels, "l string, k string")
    assert df.where(normalize_kind(F.col("l")) != F.col("k")).count() == 0


def test_table_test_reads_the_first_lines_only(spark):
    rows = [f"{i},b,c" for i in range(31)]
    bad = "\n".join("no commas" for _ in range(200))
    texts = ["\n\r\n".join(rows) + "\n" + bad, "\r\n\n" + "\n\n".join(rows) + "\n" + bad, "\n".join(rows[:20]) + "\n" + bad,
             "a,b,c\n1,2,3", "a,b,c\n1,2,3\n", "a,b,c\n1,2,3\n4,5,6", "", "\n"]
    test = looks_like_csv(F.col("t"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(test.alias("x"))
    assert [r.x for r in got.collect()] == [True, True, False, False, False, True, False, False]
    shown = got._jdf.queryExecution().analyzed().expressions().apply(0).sql()
    assert "regexp_extract" not in shown
