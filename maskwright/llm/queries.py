"""One query for each operator of this package, over the shared tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .alignment import align_tokenizers
from .chat_format import format_chats, loss_text, read_back, text_part
from .divergence import split_divergence
from .jaccard import link_near_copies
from .line_dedup import mark_later_lines
from .maxscore import nearest_vectors
from .packing import pack_scrubbed
from .quality import quality_rules
from .secret_scan import find_secrets, labelled_findings, train_network
from .superminhash import group_near_copies
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_texts
from .transducer import transduce

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack_scrubbed(docs.select("doc_id", F.col("text").alias("scrubbed")), WORD_BPE)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return link_near_copies(docs, size=3, percent=90).withColumnRenamed("id", "doc_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    messages = turns.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    chats = format_chats(messages)
    back = F.transform(read_back(F.col("formatted")),
                       lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chats.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return loss.select(
        "conv_id", "n_turns", F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("depleted", "kept_text")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, train_network(*labelled_findings(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "learned")

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_later_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"),
        F.size("later_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("later_lines").cast("array<string>"), ",").alias("removed"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transduce(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near_copies(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("task"), F.col("source").alias("split"), "text")
    return split_divergence(docs).withColumnsRenamed({"task": "lang", "split": "source"})


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_ngram_jaccard, op3_token_counts, op4_chat_formatting,
    op5_quality_rules, op6_secret_scans, op7_line_dedup, op8_bpe_transducer, op9_maxscore,
    op10_toxicity, op11_cross_tokenizer_alignment, op12_superminhash_near_dedup,
    op13_source_divergence)}
