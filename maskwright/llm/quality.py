"""Quality rules for texts, with line frequencies across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import cut_lineage

BROADCAST_LINES = 500_000
SALTS = 64
WINDOW = 8
SYMBOLS = "#*$%&|<>"
GAP = " \t\n\x0b\x0c\r"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def _repeated(ws: Column) -> Column:
    """Words covered by windows of 8 words that the text holds twice or more."""
    def of_hashes(h: Column) -> Column:
        # Equal hashes are neighbours once sorted; positions of those that have one.
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = _bind(pairs, lambda s: F.filter(s, lambda x, k: (
            F.get(s, k + 1)["h"].eqNullSafe(x["h"]) | F.get(s, k - 1)["h"].eqNullSafe(x["h"]))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        covered = F.aggregate(
            places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
            lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered).otherwise(0)

    def windows(h: Column) -> Column:
        found = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(found, F.lit(1), F.size(h) - WINDOW + 1)

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) > WINDOW, _bind(_bind(hashes, windows), of_hashes)).otherwise(0).cast("long")


def text_features(texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, GAP, "")) != "")

    def of_words(ws: Column) -> Column:
        chars = F.aggregate(ws, F.lit(0).cast("long"), lambda n, w: n + F.length(w))
        return F.struct(F.size(ws).cast("long").alias("n_words"), chars.alias("word_chars"),
                        _repeated(ws).alias("n_repeat_words"))

    found = texts.withColumn("_found", _bind(words(t), of_words))
    return found.select(
        *texts.columns, "_found.n_words", "_found.word_chars",
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "_found.n_repeat_words")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), "[\\x20\\x09-\\x0D]+", " "))


def line_print(line: Column) -> Column:
    """64 bits of a normalised line's digest, as 16 hex digits."""
    return F.substring(F.md5(normal_line(line)), 1, 16)


def line_prints(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), line_print)


def frequent_lines(texts: DataFrame, text: str, host: str, least_documents: int,
                   share_percent: int) -> DataFrame:
    """``(host, lines)``: per host the hashes of lines in too many documents.

    Documents are told apart by a digest of the whole normalised text, so that exact
    copies count once, in the documents with a line as in all documents of a host.
    """
    found = texts.select(F.col(host).alias("host"), line_prints(F.col(text)).alias("all"))
    found = found.select("host", F.md5(F.array_join("all", "")).alias("digest"),
                         F.array_distinct("all").alias("all"))
    found = cut_lineage(found.dropDuplicates(["host", "digest"]).select("host", "all"), "distinct-texts")
    documents = found.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    rows = found.select("host", F.explode("all").alias("line"))
    rows = rows.where(F.col("line") != F.substring(F.md5(F.lit("")), 1, 16))
    counts = rows.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > least_documents)
    often = counts.join(documents.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    often = often.where(100 * F.col("n") > share_percent * F.col("documents"))
    # No more than lines per document / share_percent * 100 entries for a host.
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def judged(texts: DataFrame, text: str = "text", host: str = "source", least_words: int = 20,
           repeat_percent: int = 30, least_documents: int = 50, share_percent: int = 5,
           left_percent: int = 20) -> DataFrame:
    """``row`` (all columns of ``texts``) and ``quality`` (see :func:`quality_rules`)."""
    base = texts.select(F.struct("*").alias("row"), F.col(host).alias("_host"),
                        F.coalesce(text, F.lit("")).alias("_text"))
    often = cut_lineage(frequent_lines(base.select("_host", "_text"), "_text", "_host",
                                       least_documents, share_percent), "often")
    entries = often.agg(F.sum(F.size("lines"))).first()[0] or 0
    rows = text_features(base, "_text")
    same_host = F.col("_host").eqNullSafe(F.col("host"))
    if entries <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(often), same_host, "left")
    else:
        # Texts of a host are dealt to SALTS tasks, each with a copy of the host's list.
        copies = often.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("_text"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("_salt", salt).join(copies, same_host & (F.col("_salt") == F.col("_copy")), "left")

    def without(prints: Column) -> Column:
        """The text without its lines of the list; only those it holds are searched per line."""
        kept = lambda gone: F.when(F.size(gone) == 0, F.col("_text")).otherwise(F.array_join(F.filter(
            F.split("_text", "\n"), lambda x, i: ~F.array_contains(gone, F.get(prints, i))), "\n"))
        return _bind(F.array_intersect(prints, F.col("lines")), kept)

    left = _bind(line_prints(F.col("_text")), without)
    rows = rows.withColumn("kept_text", F.when(F.col("lines").isNull(), F.col("_text")).otherwise(left))
    changed = F.col("kept_text") != F.col("_text")
    n_left = F.size(words(F.col("kept_text")))
    depleted = F.when(changed, (n_left < least_words)
                      | (100 * n_left < left_percent * F.col("n_words"))).otherwise(F.lit(False))
    failed = ((F.col("n_words") < least_words)
              | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    rows = rows.withColumn("base_failed", failed).withColumn("depleted", depleted)
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    return rows.select("row", F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "depleted", "kept_text").alias("quality"))


def quality_rules(texts: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  **limits: int) -> DataFrame:
    """Rules on each text, and on how often its lines occur on the same host.

    ``texts`` are texts to scrub, ``(doc_id, text, source)``: ``source`` is where a
    text came from, as in mapping names.  ``base_failed``: fewer than
    ``least_words`` words, or more than ``repeat_percent`` % of them in repeated
    windows.  Lines are normalised and hashed; for every host and line distinct
    documents are counted (see :func:`frequent_lines`).  A line goes when more than
    ``least_documents`` and more than ``share_percent`` % of the host's documents
    hold it.  ``depleted``: some line goes, and fewer than ``least_words`` words or
    ``left_percent`` % of the words are left.  ``kept`` is neither.

    Returns per input row ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept``, then ``depleted`` and ``kept_text`` (without
    the lines that go).  A null text is empty and fails; texts of a null host share
    a host.  Repeated rows are judged alike; null keys stay; other columns are
    ignored; an empty table gives no rows.  Native expressions only; counts are
    summed up before they are shuffled.  The lists per host are broadcast if they
    hold at most ``BROADCAST_LINES`` entries, otherwise joined by host and salt.
    """
    return judged(texts.select(*{key: 0, text: 0, host: 0}), text, host, **limits).select(
        f"row.{key}", "quality.*")


def good_texts(texts: DataFrame, text: str = "text", host: str = "source", **limits: int) -> DataFrame:
    """The kept rows of ``texts``, all columns, without the lines that go."""
    kept = judged(texts, text, host, **limits).where("quality.kept")
    new = F.when(F.col(f"row.{text}").isNotNull(), F.col("quality.kept_text"))
    return kept.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in texts.columns])
