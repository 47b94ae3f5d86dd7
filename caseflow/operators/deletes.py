"""Deletes over a graph of references: what goes, what loses a reference, what forbids it, and the rewrite of stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import delete_table, pin


@dataclass(frozen=True)
class Reference:
    """Column ``column`` of ``child`` names a row of ``parent``; ``rule`` says what becomes of the child: cascade, null or protect."""

    child: str
    column: str
    parent: str
    rule: str


#: The references between the case entities.
REFERENCES = (
    Reference("category", "domain_id", "domain", "cascade"), Reference("complaint", "domain_id", "domain", "protect"),
    Reference("complaint", "category_id", "category", "protect"), Reference("complaint", "submitted_by", "user", "protect"),
    Reference("complaint", "assignee_id", "user", "null"), Reference("complaint", "duplicate_of", "complaint", "null"),
    Reference("event", "complaint_id", "complaint", "cascade"), Reference("prediction", "complaint_id", "complaint", "cascade"),
    Reference("event", "prediction_id", "prediction", "null"), Reference("event", "actor_id", "user", "null"),
)


@dataclass
class DeletePlan:
    """``gone``: ids to delete per table. ``nulled``: ids per (table, column). ``refused``: (child, column, child_id, parent_id) of rows that forbid the delete."""

    gone: dict[str, DataFrame]
    refused: DataFrame
    nulled: dict[tuple[str, str], DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        """(effect, entity, n)"""
        parts = [df.agg(F.lit("deleted").alias("effect"), F.lit(name).alias("entity"), F.count("*").alias("n")) for name, df in self.gone.items()]
        parts += [df.agg(F.lit("nulled").alias("effect"), F.lit(f"{child}.{column}").alias("entity"), F.count("*").alias("n")) for (child, column), df in self.nulled.items()]
        refused = self.refused.groupBy(F.lit("refused").alias("effect"), F.concat_ws(".", "child", "column").alias("entity")).agg(F.count("*").alias("n"))
        return reduce(DataFrame.unionByName, [*parts, refused]).filter("n > 0")


def plan_deletes(tables: dict[str, DataFrame], deletes: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DeletePlan:
    """Follow cascades from ``deletes`` (ids per table) until nothing more goes, then see what stays behind.

    A row that goes itself neither forbids a delete nor loses a reference. Each step joins the rows found last with the tables that refer to them.
    """
    gone = {name: pin(df.select("id").distinct(), "gone") for name, df in deletes.items()}
    work = list(gone.items())
    while work:
        parent, found = work.pop()
        for r in references:
            if r.parent != parent or r.rule != "cascade" or r.child not in tables:
                continue
            more = tables[r.child].join(found.select(F.col("id").alias(r.column)), r.column, "left_semi").select("id").distinct()
            if r.child in gone:
                more = more.join(gone[r.child], "id", "left_anti")
            more = pin(more, "gone")
            if more.limit(1).count():
                gone[r.child] = gone[r.child].unionByName(more) if r.child in gone else more
                work.append((r.child, more))

    refused, nulled = [], {}
    for r in references:
        if r.rule == "cascade" or r.parent not in gone or r.child not in tables:
            continue
        left = tables[r.child].select("id", r.column).join(gone[r.parent].select(F.col("id").alias(r.column)), r.column, "left_semi")
        if r.child in gone:
            left = left.join(gone[r.child], "id", "left_anti")
        if r.rule == "null":
            nulled[r.child, r.column] = left.select("id")
        else:
            refused.append(left.select(F.lit(r.child).alias("child"), F.lit(r.column).alias("column"), F.col("id").alias("child_id"), F.col(r.column).alias("parent_id")))
    spark = next(iter(tables.values())).sparkSession
    empty = spark.createDataFrame([], "child STRING, column STRING, child_id LONG, parent_id LONG")
    return DeletePlan(gone, reduce(DataFrame.unionByName, refused, empty), nulled)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def store(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """A table in folders of ids, as ``apply`` rewrites it."""
    rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).write.partitionBy("bucket").parquet(path)


def apply(spark: SparkSession, root: str, plan: DeletePlan, buckets: int = 64) -> int:
    """Carry out ``plan`` on the tables stored under ``root``: the number of folders written anew. Folders without a row that is concerned are not touched.

    A plan that something forbids raises and writes nothing.
    """
    if plan.refused.limit(1).count():
        raise ValueError("rows that are referred to cannot be deleted")
    written = 0
    for name in sorted({*plan.gone, *(child for child, _ in plan.nulled)}):
        path = f"{root}/{name}"
        gone = plan.gone.get(name)
        columns = {column: ids for (child, column), ids in plan.nulled.items() if child == name}
        ids = reduce(DataFrame.unionByName, [df.select("id") for df in (*columns.values(), *([] if gone is None else [gone]))])
        touched = [r.bucket for r in ids.select(bucket_of(F.col("id"), buckets).alias("bucket")).distinct().collect()]  # no more than there are folders
        if not touched:
            continue
        rows = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        if gone is not None:
            rows = rows.join(gone, "id", "left_anti")
        for column, without in columns.items():
            rows = rows.join(without.select("id", F.lit(True).alias("_null")).distinct(), "id", "left").withColumn(column, F.when(F.col("_null").isNull(), F.col(column))).drop("_null")
        rows = pin(rows, "rewritten")  # what is read is what is replaced
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
        kept = {r.bucket for r in rows.select("bucket").distinct().collect()}
        for bucket in set(touched) - kept:
            delete_table(spark, f"{path}/bucket={bucket}")
        written += len(touched)
    return written
