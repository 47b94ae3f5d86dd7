"""Prefix operations over an ordered table that do not depend on how keys are distributed.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Where a key may hold a large
share of the rows, the table is first range-partitioned on (key, order) and pinned with its
partition number as ``block``. Windows then run inside (block, key), and a second, tiny window
over one row per (block, key) carries totals or last values from block to block. A key of any
size is thus spread over as many tasks as its share of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import pin

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, 0)


def ordered_blocks(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """Range-partition on ``order``; ``block`` numbers the contiguous runs.

    Range bounds come from sampling, so the numbering is written down before two branches use it.
    """
    return pin(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), label)


def global_position(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """1-based rank of every row in a total order, without gathering the table in one task."""
    blocks = ordered_blocks(df, order, "position")
    # One row per block: its size is the number of range partitions.
    offsets = blocks.groupBy("block").agg(F.count("*").alias("n")).select(
        "block",
        F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(*_BEFORE)), F.lit(0)).alias("offset"),
    )
    inside = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    return (
        blocks.join(offsets, "block")
        .withColumn(name, (F.col("offset") + inside).cast("long"))
        .drop("block", "offset")
    )


def running_totals(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], inclusive: bool = True
) -> DataFrame:
    """Running sums of ``values`` per key along ``order``.

    ``df`` holds one row per (keys, order): aggregate ties first, which also combines map-side.
    """
    blocks = ordered_blocks(df, [*keys, order], "running")
    carry_window = Window.partitionBy(*keys).orderBy("block").rowsBetween(*_BEFORE)
    carried = (
        blocks.groupBy("block", *keys)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("block", *keys, *[F.coalesce(F.sum(v).over(carry_window), F.lit(0)).alias(f"carry_{v}") for v in values])
    )
    inside = Window.partitionBy("block", *keys).orderBy(order).rowsBetween(*(_UP_TO if inclusive else _BEFORE))
    sums = {v: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"carry_{v}") for v in values}
    return (
        blocks.join(carried, ["block", *keys])
        .withColumns(sums)
        .drop("block", *[f"carry_{v}" for v in values])
    )


def last_before(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    last: dict[str, Column],
    least: dict[str, Column] | None = None,
) -> DataFrame:
    """Values carried from strictly earlier rows of the same key.

    ``last`` maps output names to expressions whose latest non-null value is wanted, ``least`` to
    expressions whose smallest value is wanted.
    """
    least = least or {}
    staged = df.withColumns({f"_{n}": e for n, e in {**last, **least}.items()})
    blocks = ordered_blocks(staged, [key, *order], "carry")
    rank = F.struct(*order)
    carry_window = Window.partitionBy(key).orderBy("block").rowsBetween(*_BEFORE)
    latest = [F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), rank)).alias(n) for n in last]
    carried = (
        blocks.groupBy("block", key)
        .agg(*latest, *[F.min(f"_{n}").alias(n) for n in least])
        .select(
            "block",
            key,
            *[F.last(n, ignorenulls=True).over(carry_window).alias(f"carry_{n}") for n in last],
            *[F.min(n).over(carry_window).alias(f"carry_{n}") for n in least],
        )
    )
    inside = Window.partitionBy("block", key).orderBy(*order).rowsBetween(*_BEFORE)
    seen = {n: F.coalesce(F.last(f"_{n}", ignorenulls=True).over(inside), F.col(f"carry_{n}")) for n in last}
    seen |= {n: F.least(F.min(f"_{n}").over(inside), F.col(f"carry_{n}")) for n in least}
    names = [*last, *least]
    return (
        blocks.join(carried, ["block", key])
        .withColumns(seen)
        .drop("block", *[f"_{n}" for n in names], *[f"carry_{n}" for n in names])
    )
