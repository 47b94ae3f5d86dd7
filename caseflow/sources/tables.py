"""Parquet inputs, opened lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Attribute access to ``<directory>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


def scan_entity(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A stored entity table under its enforced schema."""
    return spark.read.schema(ddl).parquet(path)


def scan_entity_jdbc(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """The same table in a database, read in parallel ranges of its primary key."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn="id", lowerBound=lower, upperBound=upper,
                 numPartitions=partitions, **options)
        .load()
    )
