"""Predictions for submissions and triages as they arrive; a scorer that fails costs its predictions, nothing else.

Predictions are append-only. Each has an id made of its batch, its kind and its place in the batch's order, so a batch that is run again gives the same
ids; a batch's predictions that are there already are left as they are.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseflow.models.base import RESULT_COLUMN, Scorer
from caseflow.operators.keyed import append_only
from caseflow.operators.scan import global_position
from caseflow.session import delete_table, pin, scratch, table_written

log = logging.getLogger(__name__)

SUBMIT_KINDS = ("triage", "dedup")
_VERSION = {"triage": "triage.model_version", "risk": "risk.model_version"}


def _payload(kind: str):
    if kind == "triage":
        return F.to_json(F.struct("triage.category_slug", "triage.confidence"), {"ignoreNullFields": "false"})
    if kind == "dedup":
        found = F.transform("matches", lambda m: F.struct(m["complaint_id"].alias("complaint_id"), m["similarity"].alias("similarity")))
        return F.to_json(F.struct(found.alias("matches")))
    return F.to_json(F.struct("risk.band", "risk.score"))


def predictions_of(submissions: DataFrame, kind: str, scorer: Scorer, model_name: str) -> DataFrame:
    """Prediction rows (without ids) of one scorer; rows whose ``error`` column is set are left out."""
    scored = scorer(submissions)
    if "error" in scored.columns:
        scored = scored.filter(F.col("error").isNull())
    version = F.col(_VERSION[kind]) if kind in _VERSION else F.coalesce(F.get(F.col(RESULT_COLUMN[kind]), F.lit(0))["model_version"], F.lit("null"))
    return scored.select(
        F.col("id").alias("complaint_id"), F.lit(kind).alias("kind"), _payload(kind).alias("payload"), F.lit(model_name).alias("model_name"),
        version.alias("model_version"), F.col("created_at"),
    )


#: Bits of an id for the place in a batch, and the number of each kind.
PLACES, KIND_NUMBER = 36, {"triage": 0, "dedup": 1, "risk": 2}


def with_ids(rows: DataFrame, kind: str, batch_id: int) -> DataFrame:
    """``rows`` with ``id``; their order is that of complaints, then of all other columns, so equal rows alone may change places."""
    placed = global_position(rows, [F.col("complaint_id"), *(F.col(c) for c in sorted(rows.columns) if c != "complaint_id")], "_place")
    base = (4 * batch_id + KIND_NUMBER[kind]) << PLACES
    return placed.select((F.col("_place") + base).alias("id"), *rows.columns)


def append_predictions(rows: DataFrame, kind: str, batch_id: int, root: str) -> bool:
    """Append a batch's predictions of one kind, once: False if they are there already. Ids that are not new are refused."""
    spark = rows.sparkSession
    path = f"{root}/predictions/kind_of={kind}/batch_id={batch_id}"
    if table_written(spark, path):
        return False
    delete_table(spark, path)  # what an attempt that failed half-way may have left
    numbered = with_ids(rows, kind, batch_id)
    append_only(spark.createDataFrame([], numbered.schema), numbered, path)
    return True


def score_batch(batch: DataFrame, batch_id: int, scorers: dict[str, Scorer], root: str) -> None:
    """Save the complaints, then one prediction per kind. Risk is not among the kinds: it needs a triage first."""
    path = f"{root}/complaints/batch_id={batch_id}"
    if not table_written(batch.sparkSession, path):
        batch.write.mode("overwrite").parquet(path)
    saved = batch.sparkSession.read.schema(batch.schema).parquet(path)
    for kind, scorer in scorers.items():
        score(saved, kind, scorer, batch_id, root)


def score(rows: DataFrame, kind: str, scorer: Scorer, batch_id: int, root: str) -> None:
    try:
        with scratch(rows.sparkSession):
            append_predictions(predictions_of(rows, kind, scorer, f"{kind}-model"), kind, batch_id, root)
    except Exception:
        log.exception("scorer %s failed on batch %s; no predictions recorded", kind, batch_id)


def triage_moments(submissions: DataFrame, events: DataFrame, delay: str = "1 hour", within: str = "30 days") -> DataFrame:
    """Each accepted triage with the submission that it belongs to: the columns of ``submissions`` (streamed) and ``triaged_ts``.

    ``events`` (complaint_id, kind, created_at, streamed) are lifecycle events. Either may come first; rows wait for the other side as long as a triage may follow a submission
    (``within``), and rows later than ``delay`` behind the newest are dropped.
    """
    submitted = submissions.withColumn("_submitted_ts", F.col("created_at").cast("timestamp")).withWatermark("_submitted_ts", delay)
    triaged = events.filter(F.col("kind") == "category").select(F.col("complaint_id").alias("_of"), F.col("created_at").cast("timestamp").alias("triaged_ts")).withWatermark("triaged_ts", delay)
    met = submitted.join(triaged, F.expr(f"id = _of AND triaged_ts >= _submitted_ts AND triaged_ts <= _submitted_ts + INTERVAL {within}"))
    return met.drop("_of", "_submitted_ts")


def start_risk(submissions: DataFrame, events: DataFrame, scorer: Scorer, root: str, checkpoint: str, **options: str) -> StreamingQuery:
    """A risk prediction for every triage: the due date follows from the category that was confirmed, so there is none before."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("created_at", F.col("triaged_ts").cast("timestamp_ntz")).drop("triaged_ts")
        with scratch(batch.sparkSession):
            score(pin(rows, "triaged"), "risk", scorer, batch_id, root)

    return (
        triage_moments(submissions, events, **options).writeStream.outputMode("append").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def start(submissions: DataFrame, scorers: dict[str, Scorer], root: str, checkpoint: str) -> StreamingQuery:
    unknown = set(scorers) - set(SUBMIT_KINDS)
    if unknown:
        raise ValueError(f"not scored at submission: {sorted(unknown)}")
    return (
        submissions.writeStream.foreachBatch(lambda df, batch_id: score_batch(df, batch_id, scorers, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
