"""Session helpers: reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it on, the files of a write's shuffles go when the write is done, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch that Spark hands to a Python worker.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parquet of rows that are megabytes each: pages and row groups are measured after every row, so a task holds few of them.
LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
#: Paths that open scopes wrote, innermost last.
_scopes: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files make fewer partitions than that; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the cluster names in ``spark.checkpoint.dir``.

    Only on a local master (tests, a laptop) a temporary folder takes its place where that is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quellspan-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; it goes at the end of the innermost scope, with ``keep`` of the one around that."""
    path = f"{shared_dir(spark)}/quellspan/{name}-{uuid.uuid4().hex[:12]}"
    open_ = _scopes[:-1] if keep else _scopes
    if open_:
        open_[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a work path from whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope of intermediate tables: what is written inside goes at its end, but for what is written with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            removed(spark, path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as each query ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Queries run inside hand their workers Arrow batches of about ``size`` bytes, or of one longer row."""
    before = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, before)


def written(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False, options: dict | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name, keep)
    with tidy(spark):
        df.write.options(**(options or {})).option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
