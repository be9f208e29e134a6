import pandas as pd
from pyspark.sql import functions as F

from maskwright.operators import spans as sp
from maskwright.operators.finder import STRATEGIES, find_spans, run_finder


def as_tuples(spans):
    return [(s.text, s.kind, s.essential) for s in spans]


def test_parse(spark):
    source = "Jola Whitfield works at Kestrel in Turku. Really? one two three four five six seven eight nine"
    raw = ("- Jola Whitfield | person | no\n2. Kestrel|Company|YES\n* Turku\nNONE\n\n"
           "Jola Whitfield | org | yes\nNot there | city | no\nReally? | x | no\n"
           "one two three four five six seven eight nine | x | no\n | city | no")
    df = spark.createDataFrame([(raw, source)], "r string, s string")
    got = df.select(sp.parse_response(F.col("r"), F.col("s"))).first()[0]
    assert as_tuples(got) == [("Jola Whitfield", "person_name", False),
                              ("Kestrel", "organization", True),
                              ("Turku", "other_sensitive", False)]


def spans_of(*items):
    return [dict(text=t, kind=k, essential=e) for t, k, e in items]


def test_dual_lens(spark):
    a = spans_of(("Jola Whitfield", "person_name", True))
    b = spans_of(("jola", "person_name", False), ("Jola", "person_name", False),
                 ("Slack", "project_or_product", False), ("Anvil", "project_or_product", True),
                 ("anvil", "project_or_product", False))
    df = spark.createDataFrame([(a, b)], f"a {sp.SPAN_TYPE}, b {sp.SPAN_TYPE}")
    got = df.select(sp.dual_lens_merge(F.col("a"), F.col("b"))).first()[0]
    assert as_tuples(got) == [("Jola Whitfield", "person_name", True),
                              ("Anvil", "project_or_product", False)]


def test_audit_runaway(spark):
    names = [f"Name{i}" for i in range(9)]
    text = "my colleague Name0 spoke. " + "x" * 200 + " ".join(names[1:])
    audit = spans_of(*[(n, "person_name", False) for n in names])
    df = spark.createDataFrame(
        [(text, audit, []), (text, audit[:8], [])],
        f"t string, a {sp.SPAN_TYPE}, f {sp.SPAN_TYPE}")
    got = [len(r[0]) for r in df.select(
        sp.audit_gate(F.col("a"), F.col("f"), F.col("t"))).collect()]
    assert got == [1, 8]


def make_model():
    def model(prompts: pd.Series, instructions: str, max_tokens: int) -> pd.Series:
        if prompts.str.contains("FAIL").any():
            raise ValueError("refused")
        if instructions == "list":
            return prompts.map(lambda p: "Kestrel\nZed" if "Kestrel" in p else "NONE")
        return prompts.map(lambda p: "Kestrel | org | no" if "Kestrel" in p else "NONE")

    return model


def test_strategies(spark):
    texts = ["Ask my colleague Jola at Kestrel.", "nothing", "FAIL here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for name in [*STRATEGIES, "unknown"]:
        got = {r.i: r for r in find_spans(
            df, make_model(), strategy=name, instructions={"enumerate": "list"}).collect()}
        found = [s.text for s in got[0].model_spans]
        assert found == (["Kestrel", "Jola"] if name == "enumerate-classify" else ["Kestrel"]), name
        assert got[1].model_spans == [] and got[1].warnings == []
        assert got[2].model_spans == [] and len(got[2].warnings) == 1, name


def test_enumerate_falls_back(spark):
    def silent(prompts, instructions, max_tokens):
        if instructions == "base":
            return prompts.map(lambda p: "Kestrel | org | no")
        if instructions == "list":
            return prompts.map(lambda p: "Kestrel")
        return prompts.map(lambda p: "NONE")

    df = spark.createDataFrame([("at Kestrel today",)], "text string")
    got = find_spans(df, silent, strategy="enumerate-classify",
                     instructions={"baseline": "base", "enumerate": "list"}).first()
    assert [s.text for s in got.model_spans] == ["Kestrel"]


def test_run_finder_isolates_errors(spark):
    df = spark.createDataFrame([(0, "Kestrel"), (1, "FAIL")], "i int, chunk string").coalesce(1)
    got = {r.i: (r.raw, r.warning) for r in run_finder(df, make_model()).collect()}
    assert got == {0: ("Kestrel | org | no", None), 1: (None, "refused")}


def test_audit_gate_looks_a_span_up_once(spark):
    df = spark.createDataFrame([("Anna in the rollout, Bela",)], "text string")
    spans = F.array(*(sp.span(F.lit(w), F.lit("person_name"), F.lit(False)) for w in ("Anna", "Bela")))
    plan = df.select(sp.audit_gate(spans, sp.no_spans(), F.col("text")).alias("g"))._jdf.queryExecution().analyzed()
    shown = plan.expressions().apply(0).sql()
    assert shown.lower().count("locate(") + shown.lower().count("instr(") == 1
