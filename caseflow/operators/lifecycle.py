"""The complaint lifecycle: a table of commands becomes state, audit events and refusals.

A complaint may hold any share of the commands, so they are never gathered per complaint. The
state before each command is instead read off earlier commands with carried values, which works
because of the shape of the lifecycle. With "opened" = first valid triage or move to review:

* before it is opened a complaint is ``submitted``;
* once opened, the first start-work command always succeeds, and from then on every start-work
  command leads to (or finds) ``in_progress`` and every resolve command leads to (or finds)
  ``resolved``, so the status is told by the last of either kind;
* closing succeeds exactly when that last one is a resolve; ``closed`` and ``duplicate`` end it.

Whether a command is legal is then looked up in the transition map. Triage and assignment have
no status guard, so their previous values are plain carried values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import due_at
from caseflow.operators.duplicates import first_accepted
from caseflow.operators.keyed import validate_triage
from caseflow.operators.scan import last_before
from caseflow.session import pin

STATE_COLUMNS = [
    "complaint_id", "domain_id", "status", "category_id", "category_slug", "priority", "assignee",
    "duplicate_of", "triaged_at", "due_at", "resolved_at",
]
_BEGINNING = "0001-01-01 00:00:00"


@dataclass
class Lifecycle:
    """One row per command (``steps``) and the three results derived from it; ``denied`` are commands that were not even tried."""

    steps: DataFrame
    denied: DataFrame | None = None

    def state(self) -> DataFrame:
        order = F.col("order")
        triaged, assigned = F.col("is_triage"), F.col("op").isin("assign", "_state")
        last_triage = F.max_by(F.struct("category_id", "category_slug", "priority", "sla_hours"), F.when(triaged, order))
        ended = F.max_by(F.struct("status_after", "domain_id"), order)
        return (
            self.steps.groupBy("complaint_id")
            .agg(
                ended.alias("e"),
                last_triage.alias("t"),
                F.max_by(F.struct("assignee"), F.when(assigned, order)).alias("a"),
                F.max("accepted_canonical").alias("duplicate_of"),
                F.min("triaged_ts").alias("triaged_at"),
                F.min("resolved_ts").alias("resolved_at"),
            )
            .select(
                "complaint_id", "e.domain_id", F.col("e.status_after").alias("status"), "t.category_id", "t.category_slug",
                "t.priority", "a.assignee", "duplicate_of", "triaged_at",
                due_at(F.col("triaged_at"), F.col("t.sla_hours")).alias("due_at"), "resolved_at",
            )
        )

    def events(self) -> DataFrame:
        """Audit rows in writing order: ``ord`` counts inside a command."""
        return (
            self.steps.filter("accepted")
            .select("complaint_id", "seq", "actor_id", F.col("ts").alias("created_at"), F.posexplode(F.filter(_event_rows(), lambda e: e.isNotNull())).alias("ord", "e"))
            .select("complaint_id", "seq", F.col("ord").cast("long").alias("ord"), "e.kind", "e.from_value", "e.to_value", "actor_id", "e.prediction_id", "e.note", "created_at")
        )

    def refusals(self) -> DataFrame:
        refused = self.steps.filter(F.col("reason").isNotNull()).select("complaint_id", "seq", "ts", "op", "status_before", "reason")
        if self.denied is None:
            return refused
        return refused.unionByName(self.denied.select("complaint_id", "seq", "ts", "op", F.lit(None).cast("string").alias("status_before"), F.col("denied").alias("reason")))


def _event(kind: str, old: Column, new: Column, when: Column, prediction: Column | None = None, note: Column | None = None) -> Column:
    return F.when(when, F.struct(
        F.lit(kind).alias("kind"), old.cast("string").alias("from_value"), new.cast("string").alias("to_value"),
        (F.lit(None).cast("long") if prediction is None else prediction).alias("prediction_id"),
        (F.lit("") if note is None else note).alias("note"),
    ))


def _event_rows() -> Column:
    op, before, prediction = F.col("op"), F.col("status_before"), F.col("prediction_id")
    triage, duplicate = op == "triage", op == "mark_duplicate"
    nothing = F.lit(None)
    return F.array(
        _event("category", F.col("prev_triage.category_slug"), F.col("category_slug"), triage, prediction),
        _event("priority", F.col("prev_triage.priority"), F.col("priority"), triage),
        _event("status", before, F.lit("in_review"), triage & (before == "submitted"), note=F.lit("Triaged")),
        _event("assignment", F.col("prev_assign.assignee"), F.col("assignee"), op == "assign"),
        _event("status", before, F.col("to_status"), op == "transition", note=F.col("note")),
        _event("status", before, F.lit("duplicate"), duplicate),
        _event("duplicate", nothing, F.col("canonical_id"), duplicate, prediction),
    )


def _state_rows(snapshot: DataFrame, categories: DataFrame) -> DataFrame:
    """Earlier state as one pseudo-command per complaint that precedes all others."""
    sla = categories.select(F.col("id").alias("category_id"), "sla_hours")
    return snapshot.join(sla, "category_id", "left").select(
        F.lit(-1).cast("long").alias("seq"), F.lit(_BEGINNING).cast("timestamp_ntz").alias("ts"), "complaint_id", "domain_id", F.lit("_state").alias("op"),
        F.col("status").alias("to_status"), "category_id", "priority", "assignee", F.col("duplicate_of").alias("canonical_id"),
        "category_slug", "sla_hours", F.col("triaged_at").alias("state_triaged_at"), F.col("resolved_at").alias("state_resolved_at"),
    )


def _signals(commands: DataFrame, categories: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    """Commands with state-independent checks done and the state before them carried in."""
    rows = validate_triage(commands, categories).drop("category_domain")
    if snapshot is not None:
        rows = rows.unionByName(_state_rows(snapshot, categories), allowMissingColumns=True)
    else:
        never = F.lit(None).cast("timestamp_ntz")
        rows = rows.withColumns({"state_triaged_at": never, "state_resolved_at": never})
    op, to = F.col("op"), F.col("to_status")
    moved, state = op == "transition", op == "_state"
    valid_triage = (op == "triage") & F.col("refusal").isNull()
    rows = rows.withColumns({
        "order": F.struct("ts", "seq"),
        "is_triage": valid_triage | (state & F.col("state_triaged_at").isNotNull()),
        "opens": valid_triage | (moved & (to == "in_review")) | (state & ~to.isin("submitted", "duplicate")),
        "starts": (moved & (to == "in_progress")) | (state & to.isin("in_progress", "resolved", "closed")),
        "works": F.when((moved | state) & to.isin("in_progress", "resolved"), to).when(state & (to == "closed"), "resolved"),
    })
    return last_before(
        rows,
        "complaint_id",
        ["ts", "seq"],
        last={
            "last_start": F.when(F.col("starts"), F.col("order")),
            "last_work": F.col("works"),
            "prev_triage": F.when(F.col("is_triage"), F.struct("category_slug", "priority")),
            "prev_assign": F.when(op.isin("assign", "_state"), F.struct("assignee")),
        },
        least={"opened": F.when(F.col("opens"), F.col("order"))},
    )


def run(
    commands: DataFrame, categories: DataFrame, known: DataFrame | None = None, snapshot: DataFrame | None = None
) -> Lifecycle:
    """Fold ``commands`` in (ts, seq) order, on top of ``snapshot`` (STATE_COLUMNS) if given.

    ``known`` (complaint_id, domain_id) lists the complaints a duplicate mark may point at; it
    defaults to the complaints that have commands or a snapshot row.
    """
    order = F.col("order")
    base = F.when(F.col("opened").isNull(), "submitted").when(
        F.col("last_start").isNull() | (F.col("last_start") < F.col("opened")), "in_review"
    ).otherwise(F.col("last_work"))
    rows = pin(_signals(commands, categories, snapshot).withColumn("base_status", base), "lifecycle")

    op, to = F.col("op"), F.col("to_status")
    closes = (op.isin("transition", "_state") & (to == "closed")) & ((op == "_state") | (F.col("base_status") == "resolved"))
    closed = rows.filter(closes).groupBy("complaint_id").agg(F.min("order").alias("closed_order"))

    if known is None:
        known = rows.groupBy("complaint_id").agg(F.min("domain_id").alias("domain_id"))
    canon = known.select(F.col("complaint_id").alias("canonical_id"), F.col("domain_id").alias("canonical_domain"))
    marks = (
        rows.filter(op == "mark_duplicate")
        .filter((F.col("canonical_id") != F.col("complaint_id")) & F.col("base_status").isin("submitted", "in_review", "in_progress"))
        .join(canon, "canonical_id")
        .filter(F.col("canonical_domain") == F.col("domain_id"))
        .join(closed, "complaint_id", "left")
        .filter(F.col("closed_order").isNull() | (order < F.col("closed_order")))
        .select("complaint_id", "canonical_id", "order")
    )
    settled = rows.filter((op == "_state") & (to == "duplicate")).select("complaint_id", order.alias("dup_order"))
    duplicates = first_accepted(marks.join(settled, "complaint_id", "left_anti"), settled)
    return Lifecycle(_judge(rows, closed, duplicates, canon))


def run_authorised(judged: DataFrame, categories: DataFrame, known: DataFrame | None = None, snapshot: DataFrame | None = None) -> Lifecycle:
    """``run`` over those of ``judged`` (commands with ``denied``, see ``access.command_access``) that are not denied.

    The others change nothing and are listed among the refusals, without a status, as their actors were not shown one.
    """
    judged = pin(judged, "judged")
    fold = run(judged.filter("denied IS NULL").drop("denied"), categories, known, snapshot)
    return Lifecycle(fold.steps, judged.filter("denied IS NOT NULL"))


def _judge(rows: DataFrame, closed: DataFrame, duplicates: DataFrame, canon: DataFrame) -> DataFrame:
    """Status before and after every command, and why it was refused."""
    op, order, to = F.col("op"), F.col("order"), F.col("to_status")
    # Only marks need their canonical; the other commands skip these joins.
    blocked = duplicates.select(F.col("complaint_id").alias("canonical_id"), F.col("dup_order").alias("canonical_dup"))
    marks = rows.filter(op == "mark_duplicate").join(canon, "canonical_id", "left").join(blocked, "canonical_id", "left")
    others = rows.filter(op != "mark_duplicate")
    staged = others.unionByName(marks, allowMissingColumns=True)
    staged = staged.join(closed, "complaint_id", "left").join(duplicates, "complaint_id", "left")

    before = (
        F.when(F.col("dup_order") < order, "duplicate")
        .when(F.col("closed_order") < order, "closed")
        .otherwise(F.col("base_status"))
    )
    targets = F.element_at(S.transition_map(), F.col("status_before"))
    legal = F.array_contains(targets, to) & (to != "duplicate")
    mark_reason = (
        F.when(F.col("canonical_domain").isNull(), "unknown_canonical")
        .when(F.col("canonical_id") == F.col("complaint_id"), "self_duplicate")
        .when(F.col("canonical_dup") < order, "canonical_is_duplicate")
        .when(F.col("canonical_domain") != F.col("domain_id"), "cross_domain")
        .when(~F.array_contains(targets, "duplicate"), "status")
    )
    reason = (
        F.when(op == "triage", F.col("refusal"))
        .when((op == "transition") & ~F.coalesce(legal, F.lit(False)), "illegal_transition")
        .when(op == "mark_duplicate", mark_reason)
    )
    after = (
        F.when(op == "_state", to)
        .when(~F.col("accepted"), F.col("status_before"))
        .when(op == "transition", to)
        .when((op == "triage") & (F.col("status_before") == "submitted"), "in_review")
        .when(op == "mark_duplicate", "duplicate")
        .otherwise(F.col("status_before"))
    )
    state, accepted = op == "_state", F.col("accepted")
    return (
        staged.withColumn("status_before", before)
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull() & (op != "_state"))
        .withColumns({
            "status_after": after,
            "triaged_ts": F.when(state, F.col("state_triaged_at")).when(F.col("is_triage"), F.col("ts")),
            "resolved_ts": F.when(state, F.col("state_resolved_at")).when(accepted & (op == "transition") & (to == "resolved"), F.col("ts")),
            "accepted_canonical": F.when(state | (accepted & (op == "mark_duplicate")), F.col("canonical_id")),
        })
    )
