"""What the steps leave on disk, and how many pairs the line dedup looks at."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from maskwright import storage
from maskwright.llm import line_dedup, packing
from maskwright.llm.jaccard import link_near_copies
from maskwright.llm.line_dedup import remove_later_lines
from maskwright.llm.packing import pack_scrubbed
from maskwright.llm.queries import WORD_BPE
from maskwright.llm.secret_scan import labelled_findings
from maskwright.storage import cut_lineage, own_cuts


@pytest.fixture()
def left(tmp_path, monkeypatch):
    """Labels of the cuts in a folder of the test's own."""
    monkeypatch.setattr(storage, "checkpoint_dir", lambda spark: str(tmp_path))
    return lambda: sorted(f[:-33] for f in os.listdir(tmp_path))


def test_own_cuts(spark, left):
    with own_cuts(spark) as keep:
        one = keep(cut_lineage(spark.range(3), "one"))
        with own_cuts(spark) as keep_inner:
            cut_lineage(one, "two")
            three = keep_inner(cut_lineage(one, "three"))
            assert left() == ["one", "three", "two"]
        assert left() == ["one", "three"] and three.count() == 3
    assert left() == ["one"] and one.count() == 3
    with pytest.raises(ValueError), own_cuts(spark):
        cut_lineage(one, "four")
        raise ValueError
    cut_lineage(one, "five")
    assert left() == ["five", "one"]


def test_a_cut_leaves_no_shuffle_files(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    cut = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert files() <= before and cut.count() == 7


def test_intermediate_cuts_go(spark, left):
    rows = [(i, f"the same line of some words\nown line {i} of text {i}\npassword = abcdefgh{i:04}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert remove_later_lines(docs).count() == 20
    assert left() == ["gone", "gone-bits"]
    assert link_near_copies(docs, key="doc_id").count() == 20
    assert left() == ["gone", "gone-bits", "prefixes", "prints"]
    labelled_findings(docs)
    assert left() == ["gone", "gone-bits", "prefixes", "prints"]


def test_lines_just_too_far_apart_are_seldom_compared(spark, monkeypatch):
    """Lines with a common passage whose own words are a few too many."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"passage{k}" for k in range(52)] + [f"own{i}x{k}" for k in range(8)] + [f"some{rng.randrange(40)}"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    sizes, cut = [], line_dedup.cut_lineage

    def counted(df, label, **options):
        out = cut(df, label, **options)
        if label == "line-pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    # The common words are as rare as the others, so that all lines meet.
    monkeypatch.setattr(line_dedup, "token_ranks", lambda lines: spark.range(1).select(
        F.transform(F.sequence(F.lit(1), F.lit(line_dedup.BUCKETS)), lambda x: F.lit(0).cast("long")).alias("ranks")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in remove_later_lines(docs).collect()} == {0}
    assert max(sizes) < 60 * 59 / 2 / 4


def test_lines_that_share_too_late_tokens_are_not_paired(spark, monkeypatch):
    """Own words come first in the order, so what is left from the first common token on is too little."""
    common = [f"common{k}" for k in range(17)]
    rows = [(i, " ".join(common[:i % 17] + [f"own{i}x{k}" for k in range(2 + 2 * (i >= 30))] + common[i % 17:]))
            for i in range(60)]
    sizes, cut = [], line_dedup.cut_lineage

    def counted(df, label, **options):
        out = cut(df, label, **options)
        if label == "line-pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 17 of 21 words are common to two of the first lines, and 17 of 23 or 25 to others.
    assert {r.doc_id for r in remove_later_lines(docs).collect() if r.n_removed} == set(range(1, 30))
    # All pairs of the first lines, the earliest of each, and no other.
    assert sizes[1] <= 30 * 29 / 2 and sizes[-1] == 0


def test_texts_are_packed_from_small_batches(spark, monkeypatch):
    sizes, cut = [], packing.cut_lineage

    def spied(df, label, **options):
        if label == "pieces":
            sizes.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return cut(df, label, **options)

    monkeypatch.setattr(packing, "cut_lineage", spied)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, scrubbed string")
    assert pack_scrubbed(docs, WORD_BPE).count() == 2
    assert sizes == [2_000]
