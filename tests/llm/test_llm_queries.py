"""Queries of the optional package and the pipeline on the smallest tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{folder}/{k}")
        frames.append(spark.read.parquet(f"{folder}/{k}"))
    return frames


def test_stages_keep_columns_and_act(stages):
    docs, good, lines, alone, safe, packed = stages
    for frame in (good, lines, alone, safe):
        assert frame.dtypes == docs.dtypes
    assert good.count() < docs.count() and lines.count() == good.count()
    assert alone.count() <= lines.count() and safe.count() == alone.count()
    assert packed.select("doc_id").distinct().count() == safe.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert safe.where(F.col("n_chars") != F.length("text")).count() == 0


def test_run_equals_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(
        map(tuple, stages[-1].select(columns).collect()))
