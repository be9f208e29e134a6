"""Text files in, scrubbed files and maps out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..plans.scrub import scrub

SEP = "/"


def file_ext(path: Column) -> Column:
    """Lower-cased extension of a path, empty when there is none."""
    name = F.element_at(F.split(path, SEP), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def looks_binary(content: Column) -> Column:
    """A NUL byte among the first 8 KB."""
    head = F.decode(F.substring(content, 1, fv.BINARY_SNIFF_BYTES), "ISO-8859-1")
    return F.instr(head, F.lit("\0")) > 0


def read_text_docs(spark: SparkSession, path: str, reject_binary: bool = True) -> DataFrame:
    """One row per file: ``path, ext, kind, text, error``.

    Files with a known text extension or none are taken as they are; a file with
    another extension is taken unless it looks binary.  A file that is refused (binary, an office
    or PDF file, no UTF-8) has a null kind and text and an error, so that every file is
    accounted for.  One file is one row, so files are read whole, spread over the cluster.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw = raw.select("path", "content", file_ext(F.col("path")).alias("ext"))
    known = F.col("ext").isin([*fv.TEXT_EXTENSIONS, ""])
    error = F.when(F.col("ext").isin("docx", "pdf"), F.lit("needs a text extractor"))
    if reject_binary:
        error = error.when(~known & looks_binary(F.col("content")), F.lit("binary"))
    text = F.when(error.isNull(), F.try_validate_utf8(F.col("content").cast("string")))
    error = F.coalesce(error, F.when(text.isNull(), F.lit("not UTF-8")))
    return raw.select(
        "path",
        F.when(F.col("ext") == "", "txt").otherwise(F.col("ext")).alias("ext"),
        F.when(error.isNull(), F.lit("plainText")).alias("kind"),
        text.alias("text"),
        error.alias("error"),
    )


def scrubbed_path(path: Column, ext: Column) -> Column:
    """``<folder>/<base>.scrubbed.<ext>``; PDF text becomes ``txt``."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.element_at(F.split(path, SEP), -1)
    base = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    out_ext = F.when(ext == "pdf", F.lit("txt")).otherwise(ext)
    return F.concat(folder, base, F.lit(".scrubbed."), out_ext)


def write_scrubbed(scrubbed: DataFrame, out: str, fmt: str = "parquet") -> None:
    """Write the scrubbed texts; ``fmt`` is parquet, json or text."""
    if fmt == "text":
        scrubbed.select(F.col("scrubbed").alias("value")).write.mode("overwrite").text(out)
    else:
        scrubbed.write.mode("overwrite").format(fmt).save(out)


def scrub_result_json(scrubbed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, result`` with ``{"scrubbed", "spans", "mapping"}`` as JSON."""
    return scrubbed.select(
        *keys, F.to_json(F.struct("scrubbed", "spans", "mapping")).alias("result")
    )


def scrub_path(spark: SparkSession, source: str, out: str, **options) -> DataFrame:
    """Scrub a folder of text files; returns kept and scrubbed span counts per file.

    Writes the texts with their suggested names to ``<out>/texts`` and one map
    row per pair to ``<out>/mappings``.
    """
    docs = read_text_docs(spark, source)
    done = scrub(docs, **options).withColumn(
        "out_path", scrubbed_path(F.col("path"), F.col("ext"))
    )
    done.write.mode("overwrite").parquet(f"{out}/texts")
    stored = spark.read.parquet(f"{out}/texts")
    stored.select("path", F.explode_outer("mapping").alias("fake", "real")).where(
        F.col("fake").isNotNull()
    ).write.mode("overwrite").parquet(f"{out}/mappings")
    return stored.select(
        "path", "out_path",
        F.size(F.filter("spans", lambda s: s["scrubbed"])).alias("n_scrubbed"),
        F.size(F.filter("spans", lambda s: ~s["scrubbed"])).alias("n_kept"),
    )
