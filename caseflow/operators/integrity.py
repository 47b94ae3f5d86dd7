"""Constraints as queries: every rule reports how many rows violate it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import due_at


def _count(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n_violations"))


def integrity_report(
    complaints: DataFrame, domains: DataFrame, categories: DataFrame, events: DataFrame, predictions: DataFrame
) -> DataFrame:
    status, dup = F.col("status"), F.col("duplicate_of")
    # Rules that need only the row itself share one scan.
    local = {
        "duplicate_requires_canonical": (status == "duplicate") & dup.isNull(),
        "duplicate_of_is_not_self": dup == F.col("id"),
        "complaint_status_known": ~status.isin(list(S.STATUSES)),
        "complaint_priority_known": ~F.col("priority").isin(list(S.PRIORITIES)),
    }
    counts = complaints.agg(*[F.count_if(c).alias(rule) for rule, c in local.items()])
    parts = [counts.unpivot([], list(local), "rule", "n_violations")]

    parts.append(_count(domains.groupBy("slug").count().filter("count > 1"), "domain_slug_unique"))
    parts.append(_count(categories.groupBy("domain_id", "slug").count().filter("count > 1"), "category_slug_unique_per_domain"))
    parts.append(_count(categories.filter(F.col("sla_hours") <= 0), "sla_hours_positive"))

    canonical = complaints.select(
        F.col("id").alias("duplicate_of"), status.alias("c_status"), dup.alias("c_dup"), F.col("domain_id").alias("c_domain")
    )
    linked = complaints.filter(dup.isNotNull()).join(canonical, "duplicate_of")
    pair_rules = {
        "canonical_is_not_duplicate": (F.col("c_status") == "duplicate") | F.col("c_dup").isNotNull(),
        "duplicate_inside_domain": F.col("c_domain") != F.col("domain_id"),
    }
    parts.append(linked.agg(*[F.count_if(c).alias(r) for r, c in pair_rules.items()]).unpivot([], list(pair_rules), "rule", "n_violations"))

    named = categories.select(F.col("id").alias("category_id"), F.col("domain_id").alias("k_domain"), F.col("sla_hours").alias("k_sla"))
    categorised = complaints.filter(F.col("category_id").isNotNull()).join(named, "category_id")
    category_rules = {
        "category_inside_domain": F.col("k_domain") != F.col("domain_id"),
        "due_at_follows_triage": ~F.col("due_at").eqNullSafe(due_at(F.col("triaged_at"), F.col("k_sla"))),
    }
    parts.append(categorised.agg(*[F.count_if(c).alias(r) for r, c in category_rules.items()]).unpivot([], list(category_rules), "rule", "n_violations"))

    with_history = events.filter(F.col("kind") == "status").select(F.col("complaint_id").alias("id"))
    parts.append(_count(complaints.filter(status != "submitted").join(with_history, "id", "left_anti"), "status_has_history"))
    parts.append(_count(events.filter(~F.col("kind").isin(list(S.EVENT_KINDS))), "event_kind_known"))
    parts.append(_count(predictions.filter(~F.col("kind").isin(list(S.PREDICTION_KINDS))), "prediction_kind_known"))
    return reduce(DataFrame.unionByName, [p.select("rule", F.col("n_violations").cast("long")) for p in parts])
