"""Predictions against the human decisions that followed them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import join_key, payload_match_ids, payload_slug


def verdicts(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """``accepted``: true, false, or null where there is nothing to accept.

    The rule follows the kind of the prediction, never the kind of the event.
    """
    p = predictions.select(
        F.col("id").alias("_prediction"), F.col("kind").alias("prediction_kind"), "payload", "model_version"
    )
    accepted = F.when(
        F.col("prediction_kind") == "triage", payload_slug(F.col("payload")).eqNullSafe(F.col("to_value"))
    ).when(
        F.col("prediction_kind") == "dedup",
        F.coalesce(F.array_contains(payload_match_ids(F.col("payload")), F.col("to_value")), F.lit(False)),
    )
    keyed = events.withColumn("_prediction", join_key(F.col("prediction_id"), F.col("id")))
    return keyed.join(p, "_prediction", "left").drop("_prediction").withColumn("accepted", accepted)


def acceptance_rate(judged: DataFrame) -> DataFrame:
    return (
        judged.filter(F.col("accepted").isNotNull())
        .groupBy("domain_id", "prediction_kind", "model_version")
        .agg(F.count("*").alias("n_decisions"), F.count_if("accepted").alias("n_accepted"))
        .withColumn("acceptance_rate", F.round(F.col("n_accepted") / F.col("n_decisions"), 6))
    )


def overrides(judged: DataFrame) -> DataFrame:
    return judged.filter(~F.col("accepted"))


def override_corpus(judged: DataFrame, complaints: DataFrame, with_texts: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every text on which a human decided differently from a prediction, of any kind: the retraining set.

    ``complaints`` have title and body, or get them from ``with_texts``, which sees the overridden ones only: the texts of all others are never moved.
    """
    labels = overrides(judged).select("complaint_id", "kind", F.col("to_value").alias("human_label"), "model_version")
    found = with_texts(labels.join(complaints.withColumnRenamed("id", "complaint_id"), "complaint_id"))
    return found.select("complaint_id", "kind", "human_label", "model_version", "title", "body")


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Newest prediction per (complaint, kind); an aggregate, so a busy complaint combines map-side."""
    newest = F.struct("created_at", "id")
    return predictions.groupBy("complaint_id", "kind").agg(
        F.max_by(F.struct("id", "payload", "model_name", "model_version", "created_at"), newest).alias("p")
    ).select("complaint_id", "kind", "p.*")


def model_registry(domains: DataFrame, pins: dict[str, dict[str, str]], predictions: DataFrame) -> DataFrame:
    """Serving version per (domain, kind) and how many stored predictions it made."""
    spark = domains.sparkSession
    pinned = spark.createDataFrame(
        [(slug, kind, v) for slug, kinds in pins.items() for kind, v in kinds.items()],
        "domain_slug STRING, kind STRING, pinned STRING",
    )
    wanted = domains.select(
        F.col("id").alias("domain_id"), F.col("slug").alias("domain_slug"), F.explode(F.array(*map(F.lit, S.MODEL_KINDS))).alias("kind")
    )
    used = predictions.groupBy("domain_id", "kind", "model_version").agg(F.count("*").alias("n"))
    return (
        wanted.join(pinned, ["domain_slug", "kind"], "left")
        .withColumn("model_version", F.coalesce("pinned", F.lit(S.NULL_VERSION)))
        .join(used, ["domain_id", "kind", "model_version"], "left")
        .select("domain_slug", "kind", "model_version", F.coalesce("n", F.lit(0)).cast("long").alias("n_predictions"))
    )


def history_replay_diff(complaints: DataFrame, events: DataFrame) -> DataFrame:
    """Where the state rebuilt from the audit trail differs from the stored state."""
    newest = F.struct("created_at", "id")
    last = events.groupBy(F.col("complaint_id").alias("id")).agg(*[
        F.max_by("to_value", F.when(F.col("kind") == kind, newest)).alias(f"last_{kind}")
        for kind in ("status", "category", "priority", "duplicate")
    ])
    pairs = {
        "status": (F.coalesce("last_status", F.lit("submitted")), F.col("status")),
        "category": (F.col("last_category"), F.col("category_slug")),
        "priority": (F.col("last_priority"), F.col("priority")),
        "duplicate": (F.col("last_duplicate"), F.col("duplicate_of").cast("string")),
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("field"), replayed.alias("replayed"), stored.alias("stored"))
        for name, (replayed, stored) in pairs.items()
    ])
    return (
        complaints.join(last, "id", "left")
        .select("id", F.explode(F.filter(rows, lambda r: ~r["replayed"].eqNullSafe(r["stored"]))).alias("d"))
        .select("id", "d.field", "d.replayed", "d.stored")
    )
