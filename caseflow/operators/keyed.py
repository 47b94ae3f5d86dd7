"""Intake checks and keyed writes: upsert, append-only, and the three kinds of referential delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import content_hash, join_key
from caseflow.session import pin


def validate_intake(requests: DataFrame, domains: DataFrame) -> DataFrame:
    """Trim, then require domain, title and body, an active domain and a title that fits."""
    active = domains.filter("is_active").select(F.col("id").alias("domain_id"), F.lit(True).alias("open"))
    title, body = F.trim("title"), F.trim("body")
    reason = (
        F.when(F.col("domain_id").isNull(), "domain_required")
        .when(F.coalesce(title, F.lit("")) == "", "title_required")
        .when(F.coalesce(body, F.lit("")) == "", "body_required")
        .when(F.col("open").isNull(), "domain_unavailable")
        .when(F.length(title) > S.TITLE_MAX, "title_too_long")
    )
    return requests.join(active, "domain_id", "left").select(
        "id", "domain_id", "submitted_by", title.alias("title"), body.alias("body"),
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


def new_complaints(accepted: DataFrame, created_at: Column) -> DataFrame:
    """Accepted submissions in their initial state."""
    nothing = F.lit(None)
    return accepted.select(
        "id", "domain_id", nothing.cast("long").alias("category_id"), nothing.cast("string").alias("priority"),
        F.lit("submitted").alias("status"), "title", "body", "submitted_by", nothing.cast("long").alias("assignee_id"),
        nothing.cast("long").alias("duplicate_of"), created_at.alias("created_at"),
        nothing.cast("timestamp_ntz").alias("triaged_at"), nothing.cast("timestamp_ntz").alias("due_at"),
        nothing.cast("timestamp_ntz").alias("resolved_at"),
    )


def validate_triage(commands: DataFrame, categories: DataFrame) -> DataFrame:
    """``refusal`` of a triage command, or null. Checked before any state is looked at."""
    known = categories.select(
        F.col("id").alias("category_id"), F.col("domain_id").alias("category_domain"),
        F.col("slug").alias("category_slug"), "sla_hours",
    )
    refusal = F.when(F.col("op") == "triage", (
        F.when(F.col("category_domain").isNull(), "unknown_category")
        .when(F.col("category_domain") != F.col("domain_id"), "foreign_category")
        .when(~F.coalesce(F.col("priority").isin(list(S.PRIORITIES)), F.lit(False)), "unknown_priority")
    ))
    return commands.join(known, "category_id", "left").withColumn("refusal", refusal)


def unknown_refs(references: dict[str, tuple[DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """Per reference name, how many rows point at a key that does not exist."""
    parts = []
    for name, (rows, key, targets, target_key) in references.items():
        known = targets.select(target_key.alias("_k")).distinct()
        missing = rows.select(key.alias("_k")).filter(F.col("_k").isNotNull()).join(known, "_k", "left_anti")
        parts.append(missing.agg(F.lit(name).alias("reference"), F.count("*").alias("n_missing")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_key(incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that a keyed write can't take because part of their key is null, with the first part that is."""
    part = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(k)) for k in key])
    return incoming.filter(part.isNotNull()).withColumn("missing", part)


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``target`` plus the incoming rows whose key it lacks; among equal incoming keys the lowest ``order`` wins.

    Rows with a null in their key are not written; ``missing_key`` lists them.
    """
    fresh = incoming.join(target.select(*key).distinct(), list(key), "left_anti")
    winners = fresh.groupBy(*key).agg(F.min(order).alias(order))
    return target.unionByName(fresh.join(winners, [*key, order], "left_semi").select(*target.columns))


def ingest_new(batch: DataFrame, loaded: DataFrame, order: str) -> DataFrame:
    """Rows of a batch not yet loaded, one per external id. Running it again on its own result gives nothing.

    Rows without an external id are not loaded; ``missing_key`` lists them.
    """
    # Choose winners on the narrow key first: texts never enter the aggregation.
    known = loaded.select("external_id").distinct()
    winners = batch.select("external_id", order).groupBy("external_id").agg(F.min(order).alias(order)).join(known, "external_id", "left_anti")
    return batch.join(winners, ["external_id", order], "left_semi")


def pending_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Source files whose (path, checksum) is not in the manifest: a resumed ingest reads only these."""
    return listing.join(manifest.select("path", "checksum"), ["path", "checksum"], "left_anti")


def dataset_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free content hash. The sum tells repeated rows apart, which the xor cannot."""
    h = content_hash(*[F.col(c) for c in columns])
    return df.select(h.alias("h")).agg(
        F.count("*").alias("n_rows"),
        F.expr("bit_xor(h)").alias("xor_hash"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"),
    )


def append_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that would rewrite stored ones or one another; the append is allowed only when there are none."""
    repeated = incoming.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    return incoming.join(stored.select("id").unionByName(repeated), "id", "left_semi")


def append_only(stored: DataFrame, incoming: DataFrame, path: str) -> None:
    incoming = pin(incoming, "append")  # what is checked is what is written
    if not append_conflicts(stored, incoming).isEmpty():
        raise ValueError("append-only table: rows cannot be updated")
    incoming.write.mode("append").parquet(path)


def cascade_delete(children: DataFrame, parent_key: str, deleted: DataFrame) -> DataFrame:
    """Children that survive the deletion of ``deleted`` (one column: id)."""
    return children.join(deleted.select(F.col("id").alias(parent_key)), parent_key, "left_anti")


def set_null_on_delete(rows: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    gone = deleted.select(F.col("id").alias("_key"), F.lit(True).alias("_gone")).distinct()
    keyed = rows.withColumn("_key", join_key(F.col(column), F.col("id")))
    return keyed.join(gone, "_key", "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone", "_key")


def protected_delete(deleted: DataFrame, children: DataFrame, column: str) -> DataFrame:
    """Deletions refused because something still refers to the row.

    References are made distinct first, map-side: a row that very many children refer to does not bring them all to one task.
    """
    return deleted.join(children.select(F.col(column).alias("id")).distinct(), "id", "left_semi")


def taxonomy_drift(seeded: DataFrame, declared: DataFrame) -> DataFrame:
    """Both directions of a set comparison; empty means equal."""
    extra = seeded.exceptAll(declared).withColumn("side", F.lit("undeclared"))
    return extra.unionByName(declared.exceptAll(seeded).withColumn("side", F.lit("missing")))
