"""Duplicate links: which marks are accepted, and where chains of accepted marks end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import pin


def duplicate_pairs(complaints: DataFrame) -> DataFrame:
    canonical = complaints.select(
        F.col("id").alias("duplicate_of"), F.col("status").alias("canonical_status"), F.col("domain_id").alias("canonical_domain")
    )
    return complaints.filter(F.col("duplicate_of").isNotNull()).join(canonical, "duplicate_of", "left").select(
        "id", "duplicate_of", "domain_id", "canonical_domain", "canonical_status"
    )


def first_accepted(marks: DataFrame, settled: DataFrame) -> DataFrame:
    """(complaint_id, dup_order): when each complaint first becomes a duplicate.

    ``marks`` (complaint_id, canonical_id, order) are marks that only the canonical can still
    refuse; ``settled`` (complaint_id, dup_order) are duplicates from before. A mark is accepted
    unless its canonical became a duplicate earlier, which in turn depends on that one's marks.
    Dependencies point strictly back in time, so two bounds per complaint close in on the answer:
    ``lo`` supposes only canonicals that are surely duplicates refuse, ``hi`` that all possible
    ones do. Where they meet the complaint is settled and leaves the loop.
    """
    all_marks = open_marks = pin(marks, "marks")
    settled = pin(settled, "settled")
    if all_marks.isEmpty():
        return settled
    lo = all_marks.groupBy("complaint_id").agg(F.min("order").alias("lo"))
    bounds = lo.withColumn("hi", F.lit(None).cast(lo.schema["lo"].dataType))
    parts = [settled]
    while True:
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        by_canonical = known.select(
            F.col("complaint_id").alias("canonical_id"), F.col("dup_order").alias("lo"), F.col("dup_order").alias("hi")
        ).unionByName(bounds.select(F.col("complaint_id").alias("canonical_id"), "lo", "hi"))
        order = F.col("order")
        refused_surely = F.coalesce(F.col("hi") < order, F.lit(False))
        refused_maybe = F.coalesce(F.col("lo") < order, F.lit(False))
        step = (
            open_marks.join(by_canonical, "canonical_id", "left")
            .groupBy("complaint_id")
            .agg(F.min(F.when(~refused_surely, order)).alias("lo"), F.min(F.when(~refused_maybe, order)).alias("hi"))
        )
        step = pin(step, "bounds")
        decided = F.col("lo").eqNullSafe(F.col("hi"))
        parts.append(step.filter(decided & F.col("lo").isNotNull()).select("complaint_id", F.col("lo").alias("dup_order")))
        bounds = step.filter(~decided)
        if bounds.isEmpty():
            break
        open_marks = all_marks.join(bounds.select("complaint_id"), "complaint_id", "left_semi")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def canonical_roots(edges: DataFrame) -> DataFrame:
    """(id, root, hops): the end of every chain of ``duplicate_of`` links; members of a cycle, and rows leading to one, have null for both.

    Pointer doubling: each round replaces every link by the link of its target, so after round r a link has walked 2**r steps. A
    chain has no more steps than there are links, so what has not ended after log2(links) rounds never will. One table
    holds all links, ended ones included, and is shuffled in every round: sent to all executors through the driver, it would pass there
    once for each round.
    """
    links = edges.filter(F.col("duplicate_of").isNotNull() & (F.col("duplicate_of") != F.col("id")))
    state = pin(links.select("id", F.col("duplicate_of").alias("root"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended")), "links")
    for _ in range(state.count().bit_length()):
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("hops").alias("more"), F.col("ended").alias("next_ended"))
        moving = state.filter("NOT ended").join(ahead.hint("merge"), "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.coalesce("next_ended", F.lit(True)).alias("ended"),
        )
        state = pin(state.filter("ended").unionByName(moving), "links")
        if state.filter("NOT ended").isEmpty():
            break
    ended = F.col("ended")
    return state.select("id", F.when(ended, F.col("root")).alias("root"), F.when(ended, F.col("hops")).alias("hops"))
