"""Running totals over a whole ordered table without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import pin


def running_total(df: DataFrame, order: list[str], amount: str, row: str = "row", before: str = "before") -> DataFrame:
    """``df`` in the order of ``order`` with the number of rows and the total of ``amount`` that come before each row.

    Rows are range-partitioned by the whole order, so equal leading keys may be split. Each sorted partition is summed in
    one streaming pass, and one row per partition carries the totals over.
    """
    at = df.columns.index(amount)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", row, before))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            amounts = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.cumsum(amounts)
            made = [np.full(len(amounts), part, np.int64), rows + np.arange(len(amounts)), sums - amounts]
            rows, total = rows + len(amounts), int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], names=schema.names)

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    summed = pin(ordered.mapInArrow(local, schema), "running-total")
    parts = summed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(amount).alias("_amount"))
    # One row per partition, so this window holds as many rows as the previous stage had tasks.
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_amount"),
    )
    joined = summed.join(offsets, "_part")
    return joined.select(*df.columns, (F.col(row) + F.col("_rows")).alias(row), (F.col(before) + F.col("_amount")).alias(before))
