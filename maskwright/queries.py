"""Registered queries: every operator over the shared test tables.

Each query takes ``(spark, sf_dir)`` and reads whole tables.  Where the tables
lack a shape (chat requests, answers of a model, tables inside texts), Spark
derives it from them row by row, so the work grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import fixed_values as fv
from .functions.hashing import fnv1a64, hash_hex
from .functions.synthetics import fake, fake_contextual, fake_hard
from .functions.text import csv_field_count, looks_like_csv, luhn_valid, text_lines
from .operators import candidates as cd
from .operators import score as sc
from .operators import spans as sp
from .operators.bind import bind_values, first_seen
from .operators.detect import detect_hard_ids, explode_in_order, span_summary
from .operators.finder import (
    STRATEGIES, answer_key, chunk_documents, find_spans, redacted_view,
)
from .operators.detect import detect_hits
from .operators.tabular import classify_columns, csv_text_cells, scrub_table, table_values
from .plans.chats import restore_replies, scrub_requests
from .plans.restore import restore, restore_text, split_payload
from .plans.scoped import scrub_conversations, scrub_dataset, scrub_scoped
from .plans.scrub import mapping_table, scrub, span_table
from .sources.chat import chat_fields, request_fields
from .sources.mappings import (
    load_mapping, load_scopes, mapping_conflicts, mapping_documents, mapping_file_cols, mapping_file_name,
    recent_mappings, sanitize_source, save_mapping,
)
from .sources.results import cached_results
from .sources.files import scrubbed_path
from .sources.runs import scrub_runs
from .storage import checkpoint_dir, cut_lineage, spread
from .streaming.restore import restore_events, restore_stream, use_rocksdb


# Tables with much work per row, and what to spread small copies of them by.
TEXT_KEYS = {
    "documents": "doc_id", "pages": "page_id", "customer": "c_custkey", "conversations": "conv_id",
}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


# --- shapes derived from the tables ------------------------------------------------


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One support note per customer with an identifier of every kind."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Ticket for user"), k.cast("string"), F.lit("@mail"), (k % 7).cast("string"),
        F.lit(".example.org, phone 305-555-"), digits(k % 10000, 4),
        F.lit(", SSN "), digits(k % 1000, 3), F.lit("-"), digits(k % 100, 2), F.lit("-"),
        digits(k % 10000, 4), F.lit(". Card 4"), digits(k, 15), F.lit(" was used from 10."),
        (k % 256).cast("string"), F.lit("."), (F.floor(k / 256) % 256).cast("string"),
        F.lit(".7 and fe80:"), (k % 10000).cast("string"), F.lit(":1 through db"),
        k.cast("string"), F.lit(".internal.corp with sk_live_"), digits(k, 12), F.lit("."),
    )
    return table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", text.alias("text"))


def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as small tables inside texts: 20 rows each; every third one ragged."""
    bucket = F.floor(F.col("c_custkey") / 20)
    row = F.concat(
        F.col("c_custkey").cast("string"), F.lit(",\""), F.col("c_name"), F.lit(", \"\"VIP\"\"\","),
        F.col("c_mktsegment"), F.lit(",city "), F.col("c_nationkey").cast("string"),
        F.when((bucket % 3 == 0) & (F.col("c_custkey") % 2 == 0), F.lit(",extra")).otherwise(""),
    )
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    grouped = rows.groupBy(bucket.alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("rows")
    )
    body = F.array_join(F.transform("rows", lambda r: r["row"]), "\r\n")
    return grouped.select(
        "bucket",
        F.concat(F.lit("Customer Id,Full Name,Segment,City\r\n"), body).alias("text"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind a sentence that names their first capitalised words."""
    w = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))

    def nth(i: int) -> Column:
        return F.coalesce(F.get("_w", F.lit(i)), F.lit("Nobody"))

    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("_w", w)
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("I asked my colleague "), nth(0), F.lit(" about the "), nth(1),
            F.lit(" rollout, code-named "), nth(2), F.lit(" by "), nth(3), F.lit(". "),
            F.col("text"),
        ).alias("text"),
        F.col("_w").alias("words"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-like answer about every story, with the usual faults, then its other words."""

    def word(i: int) -> Column:
        return F.coalesce(F.get("words", F.lit(i)), F.lit("Nobody"))

    raw = F.concat(
        F.lit("- "), word(0), F.lit(" | person | no\n2. "), word(1), F.lit(" | Company | yes\n* "),
        word(2), F.lit("\nNONE\n\n"), word(0), F.lit(" | org | yes\nnot in the text at all | city | no\n"),
        word(3), F.lit(" | internal-project | TRUE\n"), F.lit("my colleague "), word(0),
        F.lit(" | colleague | 1\nwhat? | other | no\n | city | no"),
    )
    kinds = F.array(F.lit("person"), F.lit("city"), F.lit("org"))
    others = F.slice("words", F.lit(5), F.greatest(F.size("words") - 4, F.lit(0)))
    raw = F.concat(raw, F.array_join(F.transform(others, lambda w, i: F.concat(
        F.lit("\n"), w, F.lit(" | "), F.get(kinds, i % 3), F.lit(" | "),
        F.when(i % 5 == 0, "yes").otherwise("no"))), ""))
    return stories(spark, sf_dir).select("doc_id", "text", "words", raw.alias("raw"))


def cases_and_outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents as labelled cases, clean ones too, and four strategies' outputs."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    docs = cut_lineage(docs.withColumn("hits", detect_hits(F.col("text"))), "cases")
    values = F.transform("hits", lambda h: h["value"])
    cases = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("task"), "text",
        F.concat(values, F.slice(values, 1, 1)).alias("pii"),
        F.transform(
            F.filter("hits", lambda h: h["kind"] == "ip_address"), lambda h: h["value"]
        ).alias("essential"),
    )

    def strategy(name: str, removed: Column, error: Column) -> DataFrame:
        gone = F.aggregate(
            removed, F.col("text"), lambda t, v: F.replace(t, v, F.lit("[x]"))
        )
        return docs.select(
            F.lit(name).alias("strategy"), F.col("doc_id").alias("id"),
            F.when(error.isNull(), gone).alias("scrubbed"),
            F.transform(
                removed, lambda v: F.struct(v.alias("text"), F.lit(True).alias("scrubbed"))
            ).alias("spans"),
            error.alias("error"),
        )

    no_error = F.lit(None).cast("string")
    some = F.transform(
        F.filter("hits", lambda h: h["kind"].isin("email", "phone")), lambda h: h["value"]
    )
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0)))
    noisy = F.concat(values, words)
    outputs = strategy("all", values, no_error)
    outputs = outputs.unionByName(strategy("some", some, no_error))
    outputs = outputs.unionByName(strategy("none", F.slice(values, 1, 0), no_error))
    outputs = outputs.unionByName(
        strategy("noisy", noisy, F.when(F.col("n_chars") > 3000, F.lit("timeout")))
    )
    return cases, outputs


# --- detection ----------------------------------------------------------------------


def _document_hits(spark, sf_dir, *extra: str) -> DataFrame:
    return detect_hard_ids(table(spark, sf_dir, "documents", "doc_id", "text", *extra))


def hard_id_counts(spark, sf_dir):
    return _document_hits(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("doc_id").alias("n_docs")
    )


def hard_id_values(spark, sf_dir):
    return _document_hits(spark, sf_dir)


def _kind_spans(kind: str):
    def query(spark, sf_dir):
        return _document_hits(spark, sf_dir).where(F.col("kind") == kind).select("doc_id", "value")

    return query


def page_hard_ids(spark, sf_dir):
    return detect_hard_ids(table(spark, sf_dir, "pages", "page_id", "html"), "html")


def note_hard_ids(spark, sf_dir):
    return detect_hard_ids(notes(spark, sf_dir))


def card_luhn(spark, sf_dir):
    pattern = dict(fv.HARD_ID_RULES)["credit_card"]
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = F.transform(
        F.regexp_extract_all("text", F.lit(fv.REGEX_FLAGS + pattern), F.lit(0)),
        lambda m: F.trim(m),
    )
    rows = explode_in_order(docs.select("doc_id", found.alias("c")), "c", "pos", "candidate")
    return rows.withColumn("luhn", luhn_valid(F.col("candidate")))


def docs_with_pii_by_lang(spark, sf_dir):
    return _document_hits(spark, sf_dir, "lang").groupBy("lang", "kind").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_values")
    )


def rollup_kind_source(spark, sf_dir):
    return span_summary(_document_hits(spark, sf_dir, "source"), ["kind", "source"], rollup=True)


def labelled_pii(spark, sf_dir):
    per_doc = _document_hits(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return labels.join(per_doc, "doc_id", "left").groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_values")
    )


# --- scalar functions -----------------------------------------------------------------


def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        "c_custkey", hash_hex(fnv1a64(F.col("c_name"))).alias("hash0"),
        hash_hex(fnv1a64(F.col("c_name"), 7)).alias("hash7"),
    )


def contextual_fakes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    values = F.array(F.col("c_name"), F.concat_ws(" ", "c_name", "c_mktsegment"))
    rows = rows.select("c_custkey", F.explode(values).alias("real"))
    rows = rows.withColumn("kind", F.explode(F.array(*map(F.lit, fv.CONTEXT_KINDS))))
    return rows.select(
        "c_custkey", "real", "kind",
        fake_contextual(F.col("kind"), F.col("real")).alias("fake0"),
        fake_contextual(F.col("kind"), F.col("real"), 7).alias("fake7"),
    )


def hard_fakes(spark, sf_dir):
    return detect_hard_ids(notes(spark, sf_dir)).select(
        "c_custkey", "value", "kind",
        fake_hard(F.col("kind"), F.col("value")).alias("fake0"),
        fake_hard(F.col("kind"), F.col("value"), 7).alias("fake7"),
    )


# --- tables ------------------------------------------------------------------------------

SCANNED_TABLES = ["customer", "supplier", "part", "nation", "region", "events", "orders"]


def pii_columns(spark, sf_dir):
    """Kind of each column with the number of distinct values it would bind."""
    out = None
    for name in SCANNED_TABLES:
        df = table(spark, sf_dir, name)
        for column, kind in classify_columns(df).items():
            if kind == "skip":
                continue
            counted = df.select(column).agg(F.countDistinct(column).alias("n_values")).select(
                F.lit(name).alias("table_name"), F.lit(column).alias("column_name"),
                F.lit(kind).alias("kind"), "n_values",
            )
            out = counted if out is None else out.unionByName(counted)
    return out


def csv_field_counts(spark, sf_dir):
    lines = csv_texts(spark, sf_dir).select("bucket", text_lines(F.col("text")).alias("l"))
    return explode_in_order(lines, "l", "line_no", "line").select(
        "bucket", "line_no", csv_field_count(F.col("line")).alias("n_fields")
    )


def csv_or_prose(spark, sf_dir):
    tables = csv_texts(spark, sf_dir).select(F.lit("table").alias("origin"),
                                             F.col("bucket").alias("key"), "text")
    prose = table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.lit("document").alias("origin"), F.col("doc_id").alias("key"), "text")
    return tables.unionByName(prose).select(
        "origin", "key", looks_like_csv(F.col("text")).alias("is_csv")
    )


def csv_cells_found(spark, sf_dir):
    rows = csv_texts(spark, sf_dir).select("bucket", csv_text_cells(F.col("text")).alias("c"))
    return explode_in_order(rows, "c", "pos", "e").select("bucket", "pos", "e.text", "e.kind")


def scrub_csv_texts(spark, sf_dir):
    done = scrub(csv_texts(spark, sf_dir), contextual=None)
    return span_table(done, ["bucket"]).groupBy("bucket", "category", "source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("fake").alias("n_fakes")
    )


def scrub_customer(spark, sf_dir):
    done, _ = scrub_table(table(spark, sf_dir, "customer"))
    return done


def scrub_contacts(spark, sf_dir):
    """A table with personal data in a name column and inside a remark."""
    k = F.col("c_custkey")
    remark = F.concat(F.lit("asked about db"), k.cast("string"), F.lit(".internal.corp, segment "), F.col("c_mktsegment"))
    contacts = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal").select(
        "c_custkey", "c_name", F.when(k % 7 != 0, remark).alias("remark"), "c_acctbal")
    done, _ = scrub_table(contacts)
    return done


def table_mapping(spark, sf_dir):
    """Map of a table with many values per candidate set, through the large-scope path."""
    df = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    values = table_values(df, {"c_name": "person"})
    return bind_values(values, small_scope=100).select("real", "fake", "kind")


# --- contextual layer -----------------------------------------------------------------------


def chunks(spark, sf_dir):
    return chunk_documents(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "chunk_ix", "start", F.length("chunk").alias("n_chars"),
        F.md5("chunk").alias("digest"),
    )


def cue_candidates(spark, sf_dir):
    return cd.candidate_rows(stories(spark, sf_dir).drop("words"), cd.cue_candidates)


def mechanical_candidates(spark, sf_dir):
    return cd.candidate_rows(stories(spark, sf_dir).drop("words"), cd.mechanical_candidates)


def capped_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    rows = docs.select("doc_id", cd.cap_candidates(found).alias("kept"))
    return rows.select(
        "doc_id", F.size("kept").alias("n_kept"), F.array_join("kept", "\n").alias("block")
    )


def candidate_prompts(spark, sf_dir):
    """Candidate block per story for a prompt."""
    rows = stories(spark, sf_dir).withColumn("found", cd.mechanical_candidates(F.col("text")))
    return rows.select(
        "doc_id",
        cd.candidate_block(F.transform("found", lambda c: c["text"])).alias("block"),
    )


def parse_responses(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn(
        "spans", sp.parse_response(F.col("raw"), F.col("text")))
    return sp.span_rows(rows, "spans", ["doc_id"])


def kind_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    options = [
        "Person", " full name", "ORG", "school", "place", "Job-Title", "spouse", "codename",
        "other", "project or product",
    ]
    pick = F.element_at(F.array(*map(F.lit, options)), (F.col("doc_id") % len(options) + 1).cast("int"))
    return labels.select("doc_id", pick.alias("label"), sp.normalize_kind(pick).alias("kind"))


def _two_lists(spark, sf_dir) -> DataFrame:
    """Answers read as a general pass, and the story's words as a name pass."""
    rows = answers(spark, sf_dir).withColumn("a", sp.parse_response(F.col("raw"), F.col("text")))
    names = F.transform(
        F.concat("words", F.array(F.lit("Slack"), F.lit("colleague"))),
        lambda w, i: sp.span(
            F.when(i % 4 == 3, F.upper(w)).otherwise(w), F.lit("person_name"), i % 2 == 0
        ),
    )
    return rows.withColumn("b", names)


def union_spans(spark, sf_dir):
    rows = _two_lists(spark, sf_dir).withColumn("u", sp.union_spans(F.col("a"), F.col("b")))
    return sp.span_rows(rows, "u", ["doc_id"])


def dual_lens_merge(spark, sf_dir):
    rows = _two_lists(spark, sf_dir)
    rows = rows.withColumn("u", sp.dual_lens_merge(F.col("a"), F.col("b")))
    return sp.span_rows(rows, "u", ["doc_id"])


def audit_gate(spark, sf_dir):
    rows = stories(spark, sf_dir)
    audit = F.transform(
        F.concat("words", F.array(
            F.lit("github"), F.lit("[[email]]"), F.lit("rollout"), F.lit("my colleague"))),
        lambda w: sp.span(w, F.lit("other_sensitive"), F.lit(False)),
    )
    rows = rows.withColumn("audit", audit).withColumn("first", cd.cue_candidates(F.col("text")))
    rows = rows.withColumn("kept", sp.audit_gate(F.col("audit"), F.col("first"), F.col("text")))
    return sp.span_rows(rows, "kept", ["doc_id"])


def redacted_views(spark, sf_dir):
    rows = notes(spark, sf_dir).withColumn("hits", detect_hits(F.col("text")))
    return rows.select(
        "c_custkey", redacted_view(F.col("text"), sp.no_spans(), F.col("hits")).alias("redacted")
    )


PASSES = ["baseline", "names", "fewshot", "enumerate", "classify", "inject", "first", "audit"]


def stored_answers(texts: DataFrame) -> DataFrame:
    """Answers to every chunk of the texts in every pass, as a table of paid-for answers holds them.

    General passes report what follows "colleague" and "code-named", the others the
    capitalised words; some chunks were refused.
    """
    chunk = F.col("chunk")
    cues = F.concat(
        F.transform(F.regexp_extract_all(chunk, F.lit("my colleague ([A-Z][a-z]+)"), F.lit(1)),
                    lambda x: F.concat(x, F.lit(" | person_name | no"))),
        F.transform(F.regexp_extract_all(chunk, F.lit("code-named ([A-Z][a-z]+)"), F.lit(1)),
                    lambda x: F.concat(x, F.lit(" | project | "), F.when(F.length(x) % 2 == 0, "yes").otherwise("no"))))
    words = F.array_distinct(F.regexp_extract_all(chunk, F.lit("[A-Z][a-z]{2,}"), F.lit(0)))
    named = F.transform(words, lambda w: F.concat(w, F.lit(" | person | no")))
    lines = {"names": named, "audit": named, "inject": named, "enumerate": words}
    pieces = chunk_documents(texts)
    rows = F.array(*(F.struct(answer_key(p, chunk).alias("cache_key"),
                              F.array_join(lines.get(p, cues), "\n").alias("raw")) for p in PASSES))
    error = F.when(F.length(chunk) % 97 == 0, F.lit("refused"))
    return pieces.select(F.explode(rows).alias("r"), error.alias("error")).select(
        "r.cache_key", F.when(F.col("error").isNull(), F.col("r.raw")).alias("raw"), "error")


def _story_texts(spark, sf_dir) -> DataFrame:
    return stories(spark, sf_dir).select("doc_id", "text")


def finder_answers(spark, sf_dir):
    """Stored answers of the single pass, chunk by chunk."""
    texts = _story_texts(spark, sf_dir)
    pieces = chunk_documents(texts).withColumn("cache_key", answer_key("baseline", F.col("chunk")))
    answers = stored_answers(texts).dropDuplicates(["cache_key"])
    return pieces.join(answers, "cache_key", "left").select(
        "doc_id", "chunk_ix", F.col("raw").alias("answer"), F.col("error").alias("warning"))


def stored_answer_spans(spark, sf_dir):
    """Spans of the single pass over stored answers, with the texts' warnings counted."""
    texts = _story_texts(spark, sf_dir)
    answers = cut_lineage(stored_answers(texts), "answers")
    found = find_spans(texts, answers, strategy="baseline")
    rows = sp.span_rows(found, "model_spans", ["doc_id"])
    warned = found.where(F.size("warnings") > 0).select(
        "doc_id", F.lit(-1).alias("ord"), F.concat_ws("; ", "warnings").alias("text"),
        F.lit("warning").alias("kind"), F.lit(False).alias("essential"))
    return rows.unionByName(warned)


def strategy_spans(spark, sf_dir):
    """All strategies over the same stories with the same stored answers."""
    texts = cut_lineage(_story_texts(spark, sf_dir), "stories")
    answers = cut_lineage(stored_answers(texts), "answers")
    out = None
    for name in STRATEGIES:
        found = find_spans(texts, answers, strategy=name)
        rows = sp.span_rows(found, "model_spans", ["doc_id"]).select(F.lit(name).alias("strategy"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- binding, scrubbing, restoring ------------------------------------------------------------


def scrub_documents(spark, sf_dir):
    done = scrub(table(spark, sf_dir, "documents", "doc_id", "text"), contextual=None)
    return done.select(
        "doc_id", F.md5("scrubbed").alias("digest"), F.size("spans").alias("n_spans")
    )


def scrub_documents_rules(spark, sf_dir):
    done = scrub(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select(
        "doc_id", F.md5("scrubbed").alias("digest"), F.size("spans").alias("n_spans")
    )


def scrub_documents_model(spark, sf_dir):
    """Texts with the answers of a model: digests, spans and warnings."""
    texts = cut_lineage(_story_texts(spark, sf_dir), "stories")
    done = scrub(texts, contextual=cut_lineage(stored_answers(texts), "answers"))
    return done.select(
        "doc_id", F.md5("scrubbed").alias("digest"), F.size("spans").alias("n_spans"),
        F.size("warnings").alias("n_warnings"),
    )


def scrub_notes(spark, sf_dir):
    return scrub(notes(spark, sf_dir), contextual=None).select("c_custkey", "scrubbed")


def scrub_span_summary(spark, sf_dir):
    done = scrub(table(spark, sf_dir, "documents", "doc_id", "text"), contextual=None)
    return span_summary(span_table(done, ["doc_id"]))


def mapping_soundness(spark, sf_dir):
    """Conflicts of the per-text maps; none expected."""
    done = scrub(table(spark, sf_dir, "documents", "doc_id", "text"), contextual=None)
    return mapping_conflicts(mapping_table(done, "doc_id")).select(
        F.col("scope").cast("bigint").alias("doc_id"), "side", "value", "n")


def restore_roundtrip(spark, sf_dir):
    done = scrub(table(spark, sf_dir, "documents", "doc_id", "text"))
    back = restore_text(F.col("scrubbed"), F.col("mapping"))
    return done.select(
        "doc_id", (back == F.col("text")).alias("restored")
    ).groupBy("restored").agg(F.count(F.lit(1)).alias("n_docs"))


def restore_by_join(spark, sf_dir):
    """Restoring with a stored map table; failed replies stay as they are."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = cut_lineage(scrub(docs, contextual=None), "scrubbed")
    mapping = mapping_table(done, "doc_id")
    ok = F.col("doc_id") % 10 != 0
    back = restore(done, mapping, "doc_id", ["doc_id"], where=ok)
    return back.select(
        "doc_id", F.md5("restored").alias("digest")
    )


def payload_restore(spark, sf_dir):
    done = scrub(notes(spark, sf_dir), contextual=None)
    payload = F.concat(F.to_json("mapping"), F.lit(fv.PAYLOAD_SEPARATOR), F.col("scrubbed"))
    parts = done.select("c_custkey", split_payload(payload).alias("p"))
    return parts.select(
        "c_custkey", restore_text(F.col("p.text"), F.col("p.mapping")).alias("text")
    )


def scrub_chats(spark, sf_dir):
    done = scrub_conversations(table(spark, sf_dir, "conversations"))
    return done.texts.select(
        "conv_id", "turn", F.md5("scrubbed").alias("digest")
    )


def _chats_with_ids(spark, sf_dir) -> DataFrame:
    """Every turn mentions the conversation's account; one turn also its phone."""
    mail = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@chat.example.org"))
    phone = F.concat(F.lit(" or 305-555-"), digits(F.col("conv_id") % 10000, 4))
    return table(spark, sf_dir, "conversations").withColumn(
        "text",
        F.concat("text", F.lit(" Write to "), mail,
                 F.when(F.col("turn") == 0, phone).otherwise(""), F.lit(".")),
    )


def scrub_chat_ids(spark, sf_dir):
    done = scrub_conversations(_chats_with_ids(spark, sf_dir), contextual=None)
    return done.texts.select("conv_id", "turn", "scrubbed")


def scrub_chat_ids_by_join(spark, sf_dir):
    """The same through the general call, with each turn tested for a table alone."""
    turns = _chats_with_ids(spark, sf_dir)
    done = scrub_scoped(turns, "conv_id", ["turn"], csv="text")
    return done.texts.select("conv_id", "turn", "scrubbed")


def _turns_with_answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chat turns, and stored answers whose verdict on a word differs from turn to turn."""
    turns = cut_lineage(_chats_with_ids(spark, sf_dir).select("conv_id", "turn", "text"), "turns")
    chunk = F.col("chunk")
    words = F.regexp_extract_all(chunk, F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    raw = F.array_join(F.transform(words, lambda w: F.concat(
        w, F.lit(" | person | "), F.when((F.length(w) + F.length(chunk)) % 2 == 0, "yes").otherwise("no"))), "\n")
    refused = F.length(chunk) % 7 == 0
    answers = chunk_documents(turns).select(
        answer_key("baseline", chunk).alias("cache_key"), F.when(~refused, raw).alias("raw"),
        F.when(refused, F.lit("refused")).alias("error"))
    return turns, cut_lineage(answers, "answers")


def scrub_chats_model(spark, sf_dir):
    """One verdict per value and conversation, from the answers to all of its turns."""
    turns, answers = _turns_with_answers(spark, sf_dir)
    done = scrub_conversations(turns, contextual=answers, strategy="baseline")
    return done.spans.select(
        F.col("scope").cast("bigint").alias("conv_id"), "text", "category", "source", "essential", "scrubbed",
        (F.col("fake") == F.col("text")).alias("same"))


def scrub_chats_model_warnings(spark, sf_dir):
    """Turns that were checked for fixed patterns only."""
    turns, answers = _turns_with_answers(spark, sf_dir)
    done = scrub_conversations(turns, contextual=answers, strategy="baseline")
    return done.texts.select("conv_id", "turn", F.array_join("warnings", "; ").alias("warnings"))


def _json_string(text: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _request_bodies(spark, sf_dir) -> DataFrame:
    """Every conversation as a JSON request with nested tool results; some are cut short."""
    mail = F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@chat.example.org"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" Write to "), mail, F.lit("."))
    message = F.concat(
        F.lit('{"role": '), _json_string(F.coalesce("role", F.lit(""))),
        F.lit(', "content": [{"type": "text", "text": '), _json_string(said),
        F.lit('}, {"type": "tool_use", "input": {"to": "'), mail, F.lit('", "n": 1.50}}, '
              '{"type": "tool_result", "content": [{"text": "Sent to '), mail,
        F.lit('", "type": "text"}, {"type": "tool_result", "content": "Again: '), mail, F.lit('"}]}]}'))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", mail.alias("mail"), message.alias("m"))
    whole = turns.groupBy("conv_id", "mail").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    body = F.concat(
        F.lit('{"model":"m-1", "temperature": 0.70, "system": "Account '), F.col("mail"),
        F.lit('", "messages": ['), F.array_join(F.transform("ms", lambda m: m["m"]), ", "),
        F.lit('], "max_tokens": 1e3}'))
    return whole.select(
        F.col("conv_id").alias("request_id"),
        F.when(F.col("conv_id") % 50 == 0, F.substring(body, F.lit(1), F.length(body) - 1))
        .otherwise(body).alias("body"))


def scrub_request_bodies(spark, sf_dir):
    done = scrub_requests(_request_bodies(spark, sf_dir), contextual=None)
    return done.texts.select("request_id", F.md5("scrubbed").alias("digest"), "error")


def restore_reply_bodies(spark, sf_dir):
    """Replies about the stand-ins of their requests; some failed."""
    done = scrub_requests(_request_bodies(spark, sf_dir), contextual=None)
    k, mapping = F.col("scope").cast("bigint"), cut_lineage(done.mapping, "request-maps")
    body = F.concat(
        F.lit('{"id":"r'), F.col("scope"), F.lit('", "content": [{"type": "text", "text": "Sent to '), F.col("fake"),
        F.lit(', '), F.col("fake"), F.lit('"}, {"type": "tool_use", "input": {"to": "'), F.col("fake"),
        F.lit('"}}, {"type": "text", "text": "no one else"}], "usage": {"n": 1.50}}'))
    replies = mapping.where("kind = 'email'").select(
        k.alias("request_id"), body.alias("body"), F.when(k % 10 == 0, 500).otherwise(200).alias("status"))
    back = restore_replies(replies, mapping, where=F.col("status") == 200)
    return back.select("request_id", "restored")


def _adjacent_ids(spark, sf_dir) -> DataFrame:
    """Two numbers side by side that may look like one identifier together."""
    n = F.col("c_custkey")
    ssn = lambda k: F.concat(
        digits(100 + k % 500, 3), F.lit("-"), digits(10 + k % 80, 2), F.lit("-"),
        digits(1000 + (k * 7) % 9000, 4))
    text = F.concat(F.lit("ids "), ssn(n), F.lit(" "), ssn(n * 13 + 5), F.lit(" end"))
    return table(spark, sf_dir, "customer", "c_custkey").select(
        "c_custkey", (n % 20).alias("conv_id"), text.alias("text"))


def adjacent_ids_roundtrip(spark, sf_dir):
    """Identifiers side by side come back whole from a map per text, chat and dataset."""
    rows = _adjacent_ids(spark, sf_dir)
    alone = scrub(rows, contextual=None)
    out = alone.select(
        F.lit("text").alias("scope_kind"), "c_custkey",
        restore_text(F.col("scrubbed"), F.col("mapping")).alias("restored"))
    for name, done, scope in (
        ("chat", scrub_conversations(rows, turn="c_custkey", contextual=None), "conv_id"),
        ("dataset", scrub_dataset(rows, "c_custkey"), None),
    ):
        back = restore(done.texts, done.mapping, scope, ["c_custkey"])
        out = out.unionByName(back.select(F.lit(name).alias("scope_kind"), "c_custkey", "restored"))
    return out


def scrub_dataset_mixed(spark, sf_dir):
    """Tables and prose under one map: every text is routed by itself."""
    prose = table(spark, sf_dir, "documents", "doc_id", "text")
    done = scrub_dataset(prose.unionByName(csv_texts(spark, sf_dir).select(
        (-1 - F.col("bucket")).alias("doc_id"), "text")))
    return done.texts.select("doc_id", F.col("scrubbed").contains(",city ").alias("cells_left"))


def dataset_mapping(spark, sf_dir):
    """One map for all documents."""
    done = scrub_dataset(table(spark, sf_dir, "documents", "doc_id", "text"), csv=False)
    return done.mapping.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("fake").alias("n_fakes")
    )


def adopted_mapping(spark, sf_dir):
    """Going on with a stored map: known values keep their replacement."""
    rows = detect_hard_ids(notes(spark, sf_dir)).withColumn(
        "scope", (F.col("c_custkey") % 50).cast("string"))
    values = first_seen(rows, "scope", "value", "kind", F.col("c_custkey"))
    old = values.where(F.col("ord") % 2 == 0).select(
        "scope", "real", F.concat(F.lit("old-"), "real").alias("fake"))
    bound = bind_values(values, old)
    return bound.groupBy("scope", "kind").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.countDistinct("fake").alias("n_fakes"),
        F.sum(F.col("fake").startswith("old-").cast("int")).alias("n_kept"),
    )


# --- sources ----------------------------------------------------------------------------------


def chat_turns(spark, sf_dir):
    return chat_fields(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", F.length("text").alias("n_chars")
    )


def chat_requests(spark, sf_dir):
    """Texts found in a JSON request built around every chat turn."""
    turns = table(spark, sf_dir, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id")
    block = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit("  ").alias("text")),
        F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("text")),
    )
    body = F.to_json(F.struct(
        F.col("role").alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), block.alias("content"))).alias("messages"),
    ))
    return request_fields(turns.select(key, body.alias("body")), "request_id").select(
        "request_id", "ord", "path", "text"
    )


def run_table_merge(spark, sf_dir):
    """Notes cut into runs of 25 characters, rewritten as paragraphs."""
    base = notes(spark, sf_dir)
    n = F.ceil(F.length("text") / 25)
    runs = base.select(
        F.col("c_custkey").alias("path"), F.lit("document").alias("part"), F.lit(0).alias("para"),
        F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("run"), "text",
    ).withColumn("text", F.col("text").substr(F.col("run") * 25 + 1, F.lit(25)))
    hits = detect_hard_ids(base)
    mapping = hits.select(
        F.col("c_custkey").alias("scope"), F.col("value").alias("real"),
        fake(F.col("kind"), F.col("value")).alias("fake"),
    )
    return scrub_runs(runs, mapping)


def _map_files(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return docs.select(
        F.concat(
            (F.lit(1700000000) + F.col("doc_id")).cast("string"), F.lit("-"),
            sanitize_source(F.concat_ws(" ", F.col("source"), F.col("lang"), F.lit("v1.txt"))),
            F.when(F.col("doc_id") % 5 == 0, F.lit(".json")).otherwise(F.lit(".map.json")),
        ).alias("file_name")
    )


def mapping_files(spark, sf_dir):
    files = mapping_file_cols(_map_files(spark, sf_dir))
    return recent_mappings(files).select(
        "file_name", "source_name", F.unix_timestamp("saved_at").alias("epoch")
    )


def mapping_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source")
    return docs.select(
        "doc_id",
        mapping_file_name(
            F.lit(1700000000) + F.col("doc_id"), F.concat("source", F.lit(" é-report.final.txt"))
        ).alias("file_name"),
        scrubbed_path(
            F.concat(F.lit("/in/"), "source", F.lit("/doc.v"), F.col("doc_id").cast("string"),
                     F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".md")),
            F.when(F.col("doc_id") % 2 == 0, F.lit("pdf")).otherwise(F.lit("md")),
        ).alias("out_path"),
    )


def stored_mappings(spark, sf_dir):
    """Maps written as JSON documents and read back."""
    done = scrub(notes(spark, sf_dir), contextual=None)
    documents = mapping_documents(mapping_table(done, "c_custkey"))
    return load_mapping(documents).select(
        F.col("scope").cast("bigint").alias("c_custkey"), "fake", "real")


def stream_restore(spark, sf_dir):
    """Scrubbed notes cut into deltas, streamed, restored and put together again."""
    use_rocksdb(spark, bounded_run=True)
    done = cut_lineage(scrub(notes(spark, sf_dir), contextual=None), "streamed")
    n = F.ceil(F.length("scrubbed") / 17).cast("int")
    events = done.select(
        F.col("c_custkey").cast("string").alias("stream_id"), F.lit(0).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("seq"), "scrubbed",
        n.cast("long").alias("n"),
    ).select(
        "stream_id", "block", "seq",
        F.when(F.col("seq") < F.col("n"), F.expr("substring(scrubbed, int(seq * 17 + 1), 17)"))
        .alias("delta"),
        (F.col("seq") == F.col("n")).alias("is_stop"),
    )
    root = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    query = restore_stream(source, mapping_table(done, "c_custkey")).writeStream.format(
        "parquet"
    ).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    parts = spark.read.parquet(f"{root}/out")
    return parts.groupBy("stream_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p")
    ).select(
        F.col("stream_id").cast("bigint").alias("c_custkey"),
        F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"),
    )


def restore_event_stream(spark, sf_dir):
    """Scrubbed notes as reply events with other ones between them, some sent twice.

    ``passed`` is what went on unchanged, in order; ``n_lost`` numbers did not come out.
    """
    use_rocksdb(spark, bounded_run=True)
    done = cut_lineage(scrub(notes(spark, sf_dir), contextual=None), "events")
    n, seq = F.ceil(F.length("scrubbed") / 17).cast("long"), F.col("seq")
    event = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    named = lambda name: event(type=F.lit(name))
    piece = F.expr("substring(scrubbed, int(if(seq = 1, 0, seq - 2) * 17 + 1), 17)")
    delta = event(type=F.lit("content_block_delta"), index=F.lit(0),
                  delta=F.struct(F.lit("text_delta").alias("type"), piece.alias("text")))
    tool = event(type=F.lit("content_block_delta"), index=F.lit(1),
                 delta=F.struct(F.lit("input_json_delta").alias("type")))
    events = done.select("c_custkey", "scrubbed", n.alias("n"), F.explode(
        F.sequence(F.lit(0).cast("long"), n + 3)).alias("seq")).select(
        F.col("c_custkey").cast("string").alias("stream_id"), "seq",
        F.when(seq == 0, named("message_start")).when(seq == 2, tool)
        .when(seq == F.col("n") + 2, event(type=F.lit("content_block_stop"), index=F.lit(0)))
        .when(seq == F.col("n") + 3, named("message_stop")).otherwise(delta).alias("payload"),
        F.explode(F.sequence(F.lit(1), F.when((seq == 1) & (F.col("c_custkey") % 3 == 0), 2).otherwise(1))).alias("copy"))
    root = f"{checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    events.drop("copy").write.parquet(f"{root}/in")
    source = spark.readStream.schema(events.drop("copy").schema).parquet(f"{root}/in")
    query = restore_events(source, mapping_table(done, "c_custkey")).writeStream.format(
        "parquet"
    ).option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    sent = F.array_sort(F.collect_list(F.when(F.col("kind") != "late", F.struct(
        "seq", "part", "kind", F.get_json_object("payload", "$.delta.text").alias("text")))))
    other = F.filter("sent", lambda e: e["kind"] != "text")
    return spark.read.parquet(f"{root}/out").groupBy("stream_id").agg(
        sent.alias("sent"), F.count_if(F.col("kind") == "late").alias("n_late")).select(
        F.col("stream_id").cast("bigint").alias("c_custkey"),
        F.array_join(F.transform("sent", lambda e: e["text"]), "").alias("text"),
        F.array_join(F.transform(other, lambda e: e["kind"]), ",").alias("passed"), "n_late",
        (F.array_max("sent.seq") + 1 - F.size(F.array_distinct("sent.seq"))).alias("n_lost"))


# --- scoring ------------------------------------------------------------------------------------


def score_cases(spark, sf_dir):
    scores = sc.score_cases(*cases_and_outputs(spark, sf_dir))
    return scores.select(
        "strategy", "id", "task", "recall", F.size("leaks").alias("n_leaks"),
        F.size("over_scrubbed").alias("n_over"), F.size("extra_scrubbed").alias("n_extra"), "n_pii",
    )


def score_strategies(spark, sf_dir):
    return sc.score_strategies(sc.score_cases(*cases_and_outputs(spark, sf_dir)))


def rank_strategies(spark, sf_dir):
    return sc.rank_strategies(score_strategies(spark, sf_dir)).select("rank", "strategy")


def case_report(spark, sf_dir):
    return sc.case_report(sc.score_cases(*cases_and_outputs(spark, sf_dir)))


def incremental_scores(spark, sf_dir):
    """Texts without a stored result under the same key."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    keyed = docs.select(
        "doc_id", sc.cache_key(F.lit("v1"), F.lit("regex"), F.col("text")).alias("cache_key"))
    stored = keyed.where(F.col("doc_id") % 3 == 0)
    return sc.missing_results(keyed, stored)


def cached_scores(spark, sf_dir):
    """Two runs over stored results: English texts first, then all; each key is scored once."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    keyed = docs.withColumn("cache_key", sc.cache_key(F.lit("v1"), F.lit("regex"), F.col("text")))
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"

    def produce(run: int):
        return lambda rows: rows.select(
            "cache_key", F.size(detect_hits(F.col("text"))).alias("n_values"), F.lit(run).alias("run"))

    schema = "cache_key string, n_values int, run int"
    cached_results(keyed.where("lang = 'en'"), path, schema, produce(1))
    return cached_results(keyed, path, schema, produce(2)).select("doc_id", "n_values", "run")


def stored_scopes(spark, sf_dir):
    """Maps stored by scope hash and read back, with the folder that holds each."""
    done = scrub(notes(spark, sf_dir), contextual=None)
    path = f"{checkpoint_dir(spark).rstrip('/')}/maps-{uuid.uuid4().hex}"
    save_mapping(mapping_table(done, "c_custkey"), path)
    return load_scopes(spark, path).select(F.col("scope").cast("bigint").alias("c_custkey"), "fake", "real")


QUERIES = {
    "hard_id_counts": hard_id_counts,
    "hard_id_values": hard_id_values,
    "email_spans": _kind_spans("email"),
    "ip_spans": _kind_spans("ip_address"),
    "phone_spans": _kind_spans("phone"),
    "api_key_spans": _kind_spans("api_key"),
    "card_luhn": card_luhn,
    "page_hard_ids": page_hard_ids,
    "note_hard_ids": note_hard_ids,
    "docs_with_pii_by_lang": docs_with_pii_by_lang,
    "rollup_kind_source": rollup_kind_source,
    "labelled_pii": labelled_pii,
    "fnv_hash": fnv_hash,
    "contextual_fakes": contextual_fakes,
    "hard_fakes": hard_fakes,
    "pii_columns": pii_columns,
    "csv_field_counts": csv_field_counts,
    "csv_or_prose": csv_or_prose,
    "csv_cells_found": csv_cells_found,
    "scrub_csv_texts": scrub_csv_texts,
    "scrub_customer": scrub_customer,
    "scrub_contacts": scrub_contacts,
    "table_mapping": table_mapping,
    "chunks": chunks,
    "cue_candidates": cue_candidates,
    "mechanical_candidates": mechanical_candidates,
    "capped_candidates": capped_candidates,
    "candidate_prompts": candidate_prompts,
    "parse_responses": parse_responses,
    "kind_labels": kind_labels,
    "union_spans": union_spans,
    "dual_lens_merge": dual_lens_merge,
    "audit_gate": audit_gate,
    "redacted_views": redacted_views,
    "finder_answers": finder_answers,
    "strategy_spans": strategy_spans,
    "stored_answer_spans": stored_answer_spans,
    "scrub_documents": scrub_documents,
    "scrub_documents_rules": scrub_documents_rules,
    "scrub_documents_model": scrub_documents_model,
    "scrub_notes": scrub_notes,
    "scrub_span_summary": scrub_span_summary,
    "mapping_soundness": mapping_soundness,
    "restore_roundtrip": restore_roundtrip,
    "restore_by_join": restore_by_join,
    "payload_restore": payload_restore,
    "scrub_chats": scrub_chats,
    "scrub_chat_ids": scrub_chat_ids,
    "scrub_chat_ids_by_join": scrub_chat_ids_by_join,
    "scrub_chats_model": scrub_chats_model,
    "scrub_chats_model_warnings": scrub_chats_model_warnings,
    "scrub_request_bodies": scrub_request_bodies,
    "restore_reply_bodies": restore_reply_bodies,
    "dataset_mapping": dataset_mapping,
    "adjacent_ids_roundtrip": adjacent_ids_roundtrip,
    "scrub_dataset_mixed": scrub_dataset_mixed,
    "adopted_mapping": adopted_mapping,
    "chat_turns": chat_turns,
    "chat_requests": chat_requests,
    "run_table_merge": run_table_merge,
    "mapping_files": mapping_files,
    "mapping_names": mapping_names,
    "stored_mappings": stored_mappings,
    "stream_restore": stream_restore,
    "restore_event_stream": restore_event_stream,
    "score_cases": score_cases,
    "score_strategies": score_strategies,
    "rank_strategies": rank_strategies,
    "case_report": case_report,
    "incremental_scores": incremental_scores,
    "cached_scores": cached_scores,
    "stored_scopes": stored_scopes,
}
