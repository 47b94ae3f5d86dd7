"""Sharding along a Hilbert curve.

Metadata dimensions, strings by their rank among all, are quantised at their own quantiles, documents are ordered by their index on the curve through the
grid, and the order is cut into runs of near equal bytes. Neighbours in the order are near in every dimension, so min-max
statistics of a shard prune on each of them.

Texts never move: a row carries sizes and grid cells only. Null dimensions sit in the first cell, null texts have no
bytes, equal texts are adjacent unless their metadata differ, repeated rows are sharded row by row, and an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.llm.prefix import running_total
from caseflow.session import pin


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with coordinates below 2**bits (transpose form, all points at once)."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> bit) & 1)
    return index


def by_rank(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings in column ``name`` replaced by the number of rows with a smaller one; nulls stay.

    Distinct values are counted and put in order as a table, whole values, however long and however many they are.
    """
    counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    codes = running_total(counts, [name], "_n").select(F.col(name).alias("_value"), F.col("before").alias("_code"))
    there = rows.filter(F.col(name).isNotNull()).join(codes, F.col(name) == F.col("_value")).drop("_value", name).withColumnRenamed("_code", name)
    return there.unionByName(rows.filter(F.col(name).isNull()).withColumn(name, F.lit(None).cast("long")))


def hilbert_shards(
    docs: DataFrame,
    dimensions: list[Column],
    size: Column,
    carry: dict[str, Column],
    tie: list[str],
    shards: int,
    bits: int = 4,
) -> DataFrame:
    """``carry`` columns with size, curve (index), shard and slot (place in the shard); ``tie`` names the order within a cell.

    Dimensions are numbers, or strings, which are taken by their rank.
    """
    names = [f"_dim{i}" for i in range(len(dimensions))]
    rows = docs.select(*(c.alias(k) for k, c in carry.items()), size.alias("size"), *(d.alias(n) for d, n in zip(dimensions, names, strict=True)))
    for name in names:
        if isinstance(rows.schema[name].dataType, T.StringType):
            rows = by_rank(rows, name)
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    edges = rows.agg(*(F.percentile_approx(n, cuts, 10_000).alias(n) for n in names)).first()

    def cell(name: str) -> Column:
        return sum((F.coalesce((F.col(name) > e).cast("int"), F.lit(0)) for e in edges[name] or []), F.lit(0))

    @F.pandas_udf(T.LongType())
    def curve(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], bits))

    placed = pin(rows.withColumn("curve", curve(F.struct(*(cell(n).alias(n) for n in names)))).drop(*names), "curve")
    whole = placed.agg(F.sum("size")).first()[0] or 1
    run = running_total(placed, ["curve", *tie], "size")
    # The shard that holds the middle of the row's bytes.
    cut = run.withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div (2 * {whole})) as int)"))
    cut = pin(cut, "cut")
    starts = cut.groupBy("shard").agg(F.min("row").alias("_first"))
    return cut.join(starts, "shard").select(*carry, "size", "curve", "shard", (F.col("row") - F.col("_first")).alias("slot"))
