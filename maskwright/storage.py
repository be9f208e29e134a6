"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}

# Folders of the cuts made in the innermost ``own_cuts`` block.
_owned: ContextVar[list[str] | None] = ContextVar("owned_cuts", default=None)
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "maskwright", cores: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="maskwright-")
    return _local_folders[app]


def cut_lineage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder, with the writer's ``options``, and read it back.

    Unlike cached blocks, the files survive the loss of an executor, and the
    columnar form lets later steps read only the columns they need.  The shuffle files
    of the write go with its end: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if (owned := _owned.get()) is not None:
        owned.append(path)
    with sql_conf(spark, _CLEAN_SHUFFLES, "true"):
        df.write.options(**options).parquet(path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut.cut_path = path
    return cut


@contextmanager
def own_cuts(spark: SparkSession):
    """Remove the files of the cuts made inside the block at its end.

    The block gets a function ``keep``: the cuts given to it stay, and belong to the
    block around, if there is one.  What is returned from the block must not read others.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(cut: DataFrame) -> DataFrame:
        kept.append(cut.cut_path)
        return cut

    token = _owned.set(own)
    try:
        yield keep
    finally:
        _owned.reset(token)
        if (outer := _owned.get()) is not None:
            outer += kept
        for path in own:
            if path not in kept:
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when the input comes in very few pieces.

    A small file with one row group is one task, however heavy the work per row.
    Input that already has a partition per core, as any large input does, stays
    as it is and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


@contextmanager
def sql_conf(spark: SparkSession, key: str, value: str):
    """Set a session option for the jobs started inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
