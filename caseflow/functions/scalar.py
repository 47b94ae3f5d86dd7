"""Scalar expressions shared by the operators; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import schema as S


def hours(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def due_at(triaged_at: Column, sla_hours: Column) -> Column:
    """The deadline always counts from the first triage."""
    return triaged_at + hours(sla_hours)


def is_overdue(as_of: Column, due: Column | None = None, resolved: Column | None = None) -> Column:
    due = F.col("due_at") if due is None else due
    resolved = F.col("resolved_at") if resolved is None else resolved
    return due.isNotNull() & resolved.isNull() & F.coalesce(due < as_of, F.lit(False))


def is_breach(due: Column | None = None, resolved: Column | None = None) -> Column:
    """Strictly later than due; null until resolved."""
    due = F.col("due_at") if due is None else due
    resolved = F.col("resolved_at") if resolved is None else resolved
    return resolved > due


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def priority_rank(priority: Column) -> Column:
    return F.element_at(S.literal_map(S.PRIORITY_RANK), priority)


def stable_bucket(key: Column, n: int) -> Column:
    """A bucket number that any engine with md5 reproduces."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n


def content_hash(*columns: Column) -> Column:
    """60 bits of md5 over the columns, null-safe and separator-delimited, as a long."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def complaint_label(cid: Column, title: Column) -> Column:
    return F.concat(F.lit("#"), cid.cast("string"), F.lit(" "), F.substring(title, 1, 60))


def payload_slug(payload: Column) -> Column:
    return F.from_json(payload, S.TRIAGE_PAYLOAD)["category_slug"]


def payload_match_ids(payload: Column) -> Column:
    matches = F.from_json(payload, S.DEDUP_PAYLOAD)["matches"]
    ids = F.transform(matches, lambda m: m["complaint_id"].cast("string"))
    return F.coalesce(ids, F.array().cast("array<string>"))


def payload_score(payload: Column) -> Column:
    return F.from_json(payload, S.RISK_PAYLOAD)["score"]


def join_key(key: Column, row_id: Column) -> Column:
    """A nullable foreign key (of non-negative ids) for an outer join.

    Null keys match nothing but would all be shuffled to one task, so each becomes one of many
    negative numbers, which match nothing either.
    """
    return F.coalesce(key, -1 - F.pmod(F.xxhash64(row_id), F.lit(1 << 20)))
