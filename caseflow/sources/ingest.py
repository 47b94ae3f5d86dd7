"""Files into a table of raw complaints, in runs that can be stopped and started again.

A run has two phases. First the rows of files that are not yet in the manifest, one per external id and none that is loaded already, are staged in a folder of the run; then one append
to the manifest names the files, their checksums and the run. Only runs that the manifest names are part of the table, so rows that were staged by a run that never got that far are
not seen, and the next run, which takes the same number, replaces them. A file counts by path and content: one that has changed is read again, and its new rows are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.operators.keyed import ingest_new, missing_key, pending_files
from caseflow.session import pin, scratch

MANIFEST = "path STRING, checksum STRING, bytes LONG, run LONG"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, checksum, bytes) of the files under ``folder`` whose name fits; contents are read and hashed by the tasks that hold them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("checksum"), F.col("length").alias("bytes"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{root}/manifest/part=0")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/*")


def loaded(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all finished runs, with ``source_order``, their place in the run that they came from."""
    runs = [r.run for r in manifest(spark, root).select("run").distinct().collect()]  # one entry per run
    ddl = f"{S.RAW_COMPLAINT}, source_order LONG"
    paths = [f"{root}/rows/run={n}" for n in sorted(runs)]
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def ingest(spark: SparkSession, folder: str, root: str, parse: Callable[[list[str]], DataFrame], pattern: str = "*") -> int:
    """Load what is new under ``folder``; ``parse`` reads files as raw complaints. Gives the number of files read; with none there is no run."""
    with scratch(spark):
        known = manifest(spark, root)
        fresh = pin(pending_files(known, listing(spark, folder, pattern)), "pending")
        paths = [r.path for r in fresh.select("path").orderBy("path").collect()]  # the reader is given them by name
        if not paths:
            return 0
        run = 1 + (known.agg(F.max("run")).first()[0] or 0)
        # Written once, so that the order which decides between rows of one id does not change under them.
        rows = pin(parse(paths).withColumn("source_order", F.monotonically_increasing_id()), "parsed")
        stage(rows, spark, root, run)
        commit(fresh, root, run)
        return len(paths)


def stage(rows: DataFrame, spark: SparkSession, root: str, run: int) -> None:
    """First phase: the new rows of a run, in place of what an earlier attempt at it has left. Rows without an external id are set aside."""
    names = [c.split()[0] for c in S.RAW_COMPLAINT.split(", ")]
    new = ingest_new(rows, loaded(spark, root), "source_order")
    new.select(*names, "source_order").write.mode("overwrite").parquet(f"{root}/rows/run={run}")
    missing_key(rows, ["external_id"]).write.mode("overwrite").parquet(f"{root}/rejects/run={run}")


def commit(files: DataFrame, root: str, run: int) -> None:
    """Second phase: from here on the run is part of the table. A run is committed once; of two at a time one fails."""
    files.select("path", "checksum", "bytes", F.lit(run).cast("long").alias("run")).coalesce(1).write.parquet(f"{root}/manifest/part={run}")
