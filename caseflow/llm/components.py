"""Connected components of a table of links, each named by its smallest member.

Links may be any number of times as many as nodes, so they are thinned first: tasks that hold a bounded number of links each keep of these only a star around
the smallest node of each of their own components, which says the same. Null nodes are linked with nothing, and links of a node
with itself and repeated links do no harm. An empty table gives an empty result; columns besides the two ends are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import pin

#: Links that a task thins together.
TOGETHER = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that these links connect it with) for all nodes of links a - b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(one):
        low = np.minimum(label[one], label[other])
        after = label.copy()
        # Labels of labels take part, so whole trees move at once.
        for ends in (one, other):
            np.minimum.at(after, label[ends], low)
        while (after[after] != after).any():
            after = after[after]
        label = after[label]
        open_ = label[one] != label[other]
        one, other = one[open_], other[open_]
    return nodes, nodes[label]


def thinned(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes as ``links`` (u, v) do, and hardly more of them than tasks have nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def star() -> pa.RecordBatch:
            a, b = (np.concatenate(c) for c in zip(*held, strict=True))
            node, label = smallest_reachable(a, b)
            some = node != label
            return pa.RecordBatch.from_arrays([pa.array(label[some]), pa.array(node[some])], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= 2 * TOGETHER:
                yield star()
                held, n = [], 0
        if held:
            yield star()

    # Numbers of rows decide, not those of partitions, so a table of few links is thinned in one task.
    tasks = 1 + links.count() // TOGETHER
    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links`` that is linked with another one.

    Each round every node takes the smallest label around it and then its label's label, so labels travel doubling distances.
    Labels and links stay tables; only the number of changed labels reaches the driver. Joins have a written table on each side,
    so that adaptive execution can split a node with very many links.
    """
    first = pin(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u != v"), "links")
    kept = pin(thinned(first).distinct(), "links")
    both = pin(kept.union(kept.select("v", "u")), "links")
    labels = pin(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = pin(labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low")), "lower")
        jump = lower.select(F.col("u").alias("low"), F.col("low").alias("lowest"))
        after = pin(lower.join(jump, "low").select("u", F.col("lowest").alias("label"), (F.col("lowest") < F.col("label")).alias("moved")), "labels")
        labels = after.select("u", "label")
        if not after.filter("moved").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
