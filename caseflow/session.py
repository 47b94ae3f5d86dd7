"""Session defaults and the one way this package cuts lineage.

``pin`` writes a table under ``spark.checkpoint.dir`` and reads it back. Unlike an in-memory
cache it survives the loss of executors, and unlike an RDD checkpoint it stays columnar, so
later reads still prune columns and push filters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "caseflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only for local runs without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="caseflow-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df``, in a session whose Arrow batches hold about ``size`` bytes at most unless the session has a bound of its own.

    Spark's other bound counts rows only, and ten thousand long texts are more than a Python worker should hold.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(size))
    return df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before heavy work on each row: a file that Spark can't split, such as one of a single row group, would keep one core busy.

    Tables that already have a part for each core stay as they are, so nothing large is ever shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Spark deletes the shuffle files of a query that ran under this setting as soon as it has ended, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Row groups of about a megabyte, looked at after each row: readers take 4,096 rows of a group at a time, whatever their size.
LARGE_ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1"}


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned and run inside, such as writes, leave no shuffle files behind. What they read again they shuffle again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_pinned: list[str] = []


_write_options: dict[str, str] = {}


@contextmanager
def large_rows() -> Iterator[None]:
    """Tables pinned inside have rows of many kilobytes or some megabytes each, of which a reader should hold few."""
    global _write_options
    before, _write_options = _write_options, LARGE_ROWS
    try:
        yield
    finally:
        _write_options = before


def pin(df: DataFrame, label: str, read_as: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table, under another schema if ``read_as`` gives one."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.options(**_write_options).parquet(path)
    _pinned.append(path)
    return spark.read.schema(read_as or df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        deleted += bool(path.getFileSystem(hadoop_conf).delete(path, True))
    return deleted


def delete_table(spark: SparkSession, path: str) -> bool:
    """Delete a table that this package wrote and that nothing reads any more."""
    return bool(_delete(spark, [path]))


def table_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: Spark's writers put a mark into the folder when they have finished."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables pinned inside are deleted at the end, but for those written by the function that this yields, which are pins of what is around."""
    global _pinned
    outer, _pinned = _pinned, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        kept = pin(df, label)
        outer.append(_pinned.pop())
        return kept

    try:
        yield keep
    finally:
        mine, _pinned = _pinned, outer
        _delete(spark, mine)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that are pinned inside, for ``release_unread``."""
    paths: list[str] = []
    mark = len(_pinned)
    yield paths
    paths += _pinned[mark:]


def _roots_of(df: DataFrame) -> set[str] | None:
    """Folders that ``df`` reads files from; None if it reads anything that is no table of files."""
    leaves, roots = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return None
        paths = leaf.relation().location().rootPaths()
        roots |= {paths.apply(j).toUri().getPath() for j in range(paths.size())}
    return roots


def release_unread(spark: SparkSession, df: DataFrame, paths: list[str]) -> None:
    """Delete those of ``paths`` that ``df`` doesn't read, all of them at most; they leave the list."""
    roots = _roots_of(df)
    if roots is None:
        return
    plain = {p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in paths}
    if not any(root == path or root.startswith(f"{path}/") for root in roots for path in plain.values()):
        _delete(spark, paths)


def release_pins(spark: SparkSession) -> int:
    """Delete the tables ``pin`` wrote in this process, once no query needs them any more."""
    return _delete(spark, _pinned)
