"""Stored maps: files named ``<epoch>-<source><suffix>`` with ``{fake: real}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv

SUFFIX = ".map.json"
SCOPE_BUCKETS = 256


def sanitize_source(name: Column) -> Column:
    """Source name fit for a file name: no extension, 40 safe characters."""
    base = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    safe = F.regexp_replace(base, "[^A-Za-z0-9_]", "_")
    return F.when(safe == "", F.lit("document")).otherwise(
        F.substring(safe, 1, fv.SOURCE_NAME_CHARS)
    )


def mapping_file_name(epoch: Column, source: Column, suffix: str = SUFFIX) -> Column:
    return F.concat(
        epoch.cast("bigint").cast("string"), F.lit("-"), sanitize_source(source), F.lit(suffix)
    )


def mapping_file_cols(files: DataFrame, name: str = "file_name", suffix: str = SUFFIX) -> DataFrame:
    """Add ``source_name`` and ``saved_at`` parsed from the names of map files.

    Names without the suffix or without a dash are no map files.
    """
    stem = F.replace(F.col(name), F.lit(suffix), F.lit(""))
    epoch = F.regexp_extract(stem, "^([^-]*)-", 1)
    source = F.regexp_extract(stem, "(?s)^[^-]*-(.*)$", 1)
    return files.where(F.col(name).endswith(suffix) & stem.contains("-")).withColumn(
        "source_name", F.when(source == "", F.lit("document")).otherwise(source)
    ).withColumn(
        "saved_at", F.timestamp_seconds(F.coalesce(epoch.try_cast("bigint"), F.lit(0)))
    )


def recent_mappings(files: DataFrame, limit: int = fv.RECENT_LIMIT, name: str = "file_name") -> DataFrame:
    """Newest map files first."""
    return files.orderBy(F.desc("saved_at"), name).limit(limit)


def mapping_documents(mapping: DataFrame) -> DataFrame:
    """One sorted flat JSON document ``{fake: real}`` per scope."""
    return mapping.groupBy("scope").agg(
        F.to_json(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("fake", "real"))))
        ).alias("value")
    )


def scope_bucket(scope: Column, buckets: int = SCOPE_BUCKETS) -> Column:
    """Folder number of a scope in a stored map."""
    return F.pmod(F.xxhash64(scope.cast("string")), F.lit(buckets)).cast("int")


def save_mapping(mapping: DataFrame, path: str, buckets: int = SCOPE_BUCKETS) -> None:
    """Store a map as rows, whatever its size, in one folder per bucket of scopes.

    Rows are dealt out by scope and replacement, so a huge scope is written by many tasks.
    """
    rows = mapping.select(F.col("scope").cast("string").alias("scope"), "fake", "real")
    rows.withColumn("bucket", scope_bucket(F.col("scope"), buckets)).write.mode("overwrite").partitionBy(
        "bucket").parquet(path)


def load_scope(spark: SparkSession, path: str, scope: str, buckets: int = SCOPE_BUCKETS) -> DataFrame:
    """The stored map of one scope; only the files of its bucket are read."""
    number = spark.range(1).select(scope_bucket(F.lit(str(scope)), buckets)).first()[0]
    schema = "scope string, fake string, real string, bucket int"
    return spark.read.schema(schema).parquet(path).where(
        (F.col("bucket") == number) & (F.col("scope") == str(scope))).drop("bucket")


def load_scopes(spark: SparkSession, path: str) -> DataFrame:
    """The stored map of all scopes."""
    return spark.read.schema("scope string, fake string, real string, bucket int").parquet(path).drop("bucket")


def load_mapping(documents: DataFrame, scope: str = "scope", value: str = "value") -> DataFrame:
    """Pairs ``(scope, fake, real)`` of JSON map documents.

    A document that is no flat JSON object gives one row with ``error`` set.
    """
    parsed = F.from_json(F.col(value), "map<string,string>")
    rows = documents.select(F.col(scope).cast("string").alias("scope"), parsed.alias("_m"))
    broken = rows.where(F.col("_m").isNull()).select(
        "scope", F.lit(None).cast("string").alias("fake"),
        F.lit(None).cast("string").alias("real"), F.lit("not a JSON object").alias("error"),
    )
    pairs = rows.select("scope", F.explode_outer("_m").alias("fake", "real")).where(
        F.col("fake").isNotNull()
    )
    return pairs.withColumn("error", F.lit(None).cast("string")).unionByName(broken)


def read_mapping_files(spark: SparkSession, path: str, suffix: str = SUFFIX) -> DataFrame:
    """Map files of a folder as ``(file_name, source_name, saved_at, fake, real)``."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select(
        F.col("_metadata.file_name").alias("file_name"), "value"
    )
    named = mapping_file_cols(raw, suffix=suffix)
    return named.select(
        "file_name", "source_name", "saved_at",
        F.explode(F.from_json("value", "map<string,string>")).alias("fake", "real"),
    )


def mapping_conflicts(mapping: DataFrame) -> DataFrame:
    """Values or replacements that occur twice in a scope; empty for a sound map."""
    def twice(column: str) -> DataFrame:
        return mapping.groupBy("scope", F.col(column).alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        ).where("n > 1").select("scope", F.lit(column).alias("side"), "value", "n")

    return twice("real").unionByName(twice("fake"))
