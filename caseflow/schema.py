"""Entity schemas and the fixed values of the domain."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------

STATUSES = {
    "submitted": "Submitted",
    "in_review": "In review",
    "in_progress": "In progress",
    "resolved": "Resolved",
    "closed": "Closed",
    "duplicate": "Duplicate",
}
PRIORITIES = {"low": "Low", "medium": "Medium", "high": "High", "critical": "Critical"}
PRIORITY_RANK = {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
PREDICTION_KINDS = {"triage": "Triage", "dedup": "Duplicate detection", "risk": "SLA risk"}
EVENT_KINDS = {
    "status": "Status change",
    "category": "Category change",
    "priority": "Priority change",
    "assignment": "Assignment change",
    "duplicate": "Duplicate decision",
}
TRANSITIONS = {
    "submitted": ["in_review", "duplicate"],
    "in_review": ["in_progress", "duplicate"],
    "in_progress": ["resolved", "duplicate"],
    "resolved": ["closed", "in_progress"],
    "closed": [],
    "duplicate": [],
}
QUEUE_HIDDEN = ["closed", "duplicate"]
MODEL_KINDS = ["triage", "dedup", "risk"]
NULL_VERSION = "null"
PAGE_SIZE = 25
TITLE_MAX = 300
EMBEDDING_DIM = 384

SUBMITTER_PERMISSIONS = ["complaints.add_complaint", "complaints.view_complaint"]
AGENT_EXTRA_PERMISSIONS = [
    "complaints.view_queue",
    "complaints.change_complaint",
    "complaints.triage_complaint",
    "complaints.assign_complaint",
    "complaints.resolve_complaint",
    "complaints.mark_duplicate",
]
ADMIN_EXTRA_PERMISSIONS = ["domains.manage_domain", "complaints.view_ml_metrics"]
# A role bundle is its parent's bundle plus its own extras.
ROLE_PARENT = {"Submitter": None, "Agent": "Submitter", "Admin": "Agent"}
ROLE_EXTRAS = {
    "Submitter": SUBMITTER_PERMISSIONS,
    "Agent": AGENT_EXTRA_PERMISSIONS,
    "Admin": ADMIN_EXTRA_PERMISSIONS,
}
ALL_PERMISSIONS = SUBMITTER_PERMISSIONS + AGENT_EXTRA_PERMISSIONS + ADMIN_EXTRA_PERMISSIONS


def role_bundle(role: str) -> list[str]:
    parent = ROLE_PARENT[role]
    return (role_bundle(parent) if parent else []) + ROLE_EXTRAS[role]


# --- entity schemas ---------------------------------------------------------------------------


DOMAIN = "id LONG, slug STRING, name STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ"
CATEGORY = "id LONG, domain_id LONG, slug STRING, name STRING, sla_hours INT"
COMPLAINT = (
    "id LONG, domain_id LONG, category_id LONG, priority STRING, status STRING, title STRING, body STRING,"
    " submitted_by LONG, assignee_id LONG, duplicate_of LONG, embedding BINARY, created_at TIMESTAMP_NTZ,"
    " triaged_at TIMESTAMP_NTZ, due_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ"
)
PREDICTION = (
    "id LONG, complaint_id LONG, kind STRING, payload STRING, model_name STRING, model_version STRING,"
    " created_at TIMESTAMP_NTZ"
)
EVENT = (
    "id LONG, complaint_id LONG, kind STRING, from_value STRING, to_value STRING, actor_id LONG,"
    " prediction_id LONG, note STRING, created_at TIMESTAMP_NTZ"
)
COMMAND = (
    "seq LONG, ts TIMESTAMP_NTZ, complaint_id LONG, domain_id LONG, op STRING, to_status STRING, category_id LONG,"
    " priority STRING, assignee STRING, canonical_id LONG, prediction_id LONG, actor_id LONG, note STRING"
)
RAW_COMPLAINT = (
    "external_id STRING, text STRING, category_label STRING, submitted_at TIMESTAMP_NTZ,"
    " resolved_at TIMESTAMP_NTZ, sla_met BOOLEAN"
)
TRIAGE_PAYLOAD = "category_slug STRING, confidence DOUBLE"
DEDUP_PAYLOAD = "matches ARRAY<STRUCT<complaint_id: LONG, similarity: DOUBLE>>"
RISK_PAYLOAD = "band STRING, score DOUBLE"
TRIAGE_RESULT = "STRUCT<category_slug: STRING, confidence: DOUBLE, model_version: STRING>"
MATCH_RESULT = "ARRAY<STRUCT<complaint_id: LONG, similarity: DOUBLE, model_version: STRING>>"
RISK_RESULT = "STRUCT<score: DOUBLE, band: STRING, model_version: STRING>"
RISK_FEATURES = [
    "sla_hours",
    "category_mean_resolution_hours",
    "category_breach_rate",
    "priority_rank",
    "age_hours",
    "submitted_hour",
    "submitted_weekday",
    "text_length",
    "queue_depth",
    "assignee_open_count",
]


def literal_map(values: dict) -> Column:
    """A fixed dictionary as a Spark map literal."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def transition_map() -> Column:
    pairs = (
        (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))
        for k, v in TRANSITIONS.items()
    )
    return F.create_map(*chain.from_iterable(pairs))


def label(code: Column, labels: dict) -> Column:
    return F.element_at(literal_map(labels), code)
