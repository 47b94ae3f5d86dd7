"""Read views: complaint detail, work queue, pages, labels and the actions open to a viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import is_overdue, join_key
from caseflow.operators.scan import global_position


def complaint_view(complaints: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    names = users.select(F.col("id").alias("submitted_by"), F.col("username").alias("submitter"))
    return complaints.join(names, "submitted_by").select(
        "id",
        F.col("domain_id").alias("domain"),
        F.col("category_id").alias("category"),
        "priority",
        "status",
        "title",
        "body",
        F.col("submitter").alias("submitted_by"),
        F.col("assignee_id").alias("assignee"),
        "duplicate_of",
        "created_at",
        "triaged_at",
        "due_at",
        "resolved_at",
        is_overdue(as_of).alias("is_overdue"),
    )


def overdue(complaints: DataFrame, as_of: Column) -> DataFrame:
    return complaints.filter(is_overdue(as_of))


def open_queue(complaints: DataFrame) -> DataFrame:
    return complaints.filter(~F.col("status").isin(S.QUEUE_HIDDEN))


def queue_order() -> list[Column]:
    return [F.col("due_at").asc_nulls_first(), F.col("created_at").desc(), F.col("id").desc()]


def agent_queue(complaints: DataFrame, domains: DataFrame, as_of: Column) -> DataFrame:
    """The open queue with every row's place in it."""
    names = domains.select(F.col("id").alias("domain_id"), F.col("slug").alias("domain_slug"))
    rows = open_queue(complaints).select(
        "id", "domain_id", "category_slug", "status", "assignee_id", "created_at", "due_at", is_overdue(as_of).alias("is_overdue")
    )
    return global_position(rows, queue_order()).join(names, "domain_id").drop("domain_id")


def page(rows: DataFrame, order: list[Column], number: int, size: int = S.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1), found by position: a deep page costs what the first one does."""
    first = (number - 1) * size
    return global_position(rows, order, "_pos").filter(F.col("_pos").between(first + 1, first + size)).drop("_pos")


def queue_display(complaints: DataFrame, domains: DataFrame, categories: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    u = users.select(F.col("id").alias("_assignee"), F.col("username").alias("assignee_name"))
    return (
        open_queue(complaints)
        .withColumn("_assignee", join_key(F.col("assignee_id"), F.col("id")))
        .join(d, "domain_id")
        .join(c, "category_id", "left")
        .join(u, "_assignee", "left")
        .select(
            "id",
            "domain",
            F.coalesce("category_name", F.lit("Untriaged")).alias("category"),
            F.coalesce(S.label(F.col("priority"), S.PRIORITIES), F.lit("Not set")).alias("priority"),
            S.label(F.col("status"), S.STATUSES).alias("status"),
            F.coalesce("assignee_name", F.lit("Unassigned")).alias("assignee"),
            "due_at",
            F.when(is_overdue(as_of), "Overdue").otherwise("").alias("badge"),
        )
    )


def page_counts(complaints: DataFrame, users: DataFrame, size: int = S.PAGE_SIZE) -> DataFrame:
    """Pages of every user's own listing; an empty listing still has one page."""
    own = complaints.groupBy(F.col("submitted_by").alias("id")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return users.join(own, "id", "left").select(
        F.col("id").alias("user_id"),
        n.cast("long").alias("n_complaints"),
        F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("num_pages"),
    )


ACTIONS = ("can_start_work", "can_assign", "can_mark_duplicate", "can_resolve", "can_close")


def _actions() -> dict[str, Column]:
    """What a viewer with permission flags may do to a complaint of column ``status``."""
    targets = F.element_at(S.transition_map(), F.col("status"))

    def allowed(permission: str, condition: Column) -> Column:
        return F.coalesce(F.col(permission), F.lit(False)) & condition

    def reachable(status: str) -> Column:
        return F.array_contains(targets, status)

    conditions = (
        allowed("can_triage", reachable("in_progress")), allowed("can_assign", ~F.col("status").isin(S.QUEUE_HIDDEN)), allowed("can_mark_duplicate", reachable("duplicate")),
        allowed("can_resolve", reachable("resolved")), allowed("can_resolve", reachable("closed")),
    )
    return dict(zip(ACTIONS, conditions, strict=True))


def legal_actions(complaints: DataFrame, permission_flags: DataFrame) -> DataFrame:
    """What each submitter may do with an own complaint; flags come from ``access.permission_flags``."""
    flags = permission_flags.withColumnRenamed("user_id", "submitted_by")
    return complaints.join(flags, "submitted_by", "left").select("id", "status", "submitted_by", *(c.alias(name) for name, c in _actions().items()))


def viewer_actions(complaints: DataFrame, viewers: DataFrame, permission_flags: DataFrame, agents: DataFrame) -> DataFrame:
    """Per viewer (user_id) how many complaints they see, and to how many of them they may do what.

    An action depends on the viewer's permissions and the complaint's status alone, so ``agents`` (user_id), who see all complaints, meet one row per status, and all others
    their own complaints by status; no viewer is ever paired with single complaints of others.
    """
    totals = [F.struct(F.lit(r.status).alias("status"), F.lit(r.n).alias("n")) for r in complaints.groupBy("status").agg(F.count("*").alias("n")).collect()]  # one row per status
    everything = F.array(*totals) if totals else F.array().cast("array<struct<status:string,n:bigint>>")
    sees_all = viewers.join(agents, "user_id", "left_semi").select("user_id", F.explode(everything).alias("s")).select("user_id", "s.status", "s.n")
    own = complaints.groupBy(F.col("submitted_by").alias("user_id"), "status").agg(F.count("*").alias("n")).join(agents, "user_id", "left_anti")
    seen = sees_all.unionByName(own).join(permission_flags, "user_id", "left")
    counted = seen.groupBy("user_id").agg(F.sum("n").alias("n_visible"), *(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"n_{name}") for name, c in _actions().items()))
    numbers = ["n_visible", *(f"n_{name}" for name in ACTIONS)]
    return viewers.join(counted, "user_id", "left").select("user_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers))


def places_within(rows: DataFrame, key: str, order: list[Column], name: str = "pos") -> DataFrame:
    """``rows`` with each one's place among those of its ``key``.

    Places come from one total order over key and ``order``, so a key with very many rows is no single task's work.
    """
    placed = global_position(rows, [F.col(key), *order], "_pos")
    firsts = placed.groupBy(key).agg(F.min("_pos").alias("_first"))
    return placed.join(firsts, key).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


def own_list(rows: DataFrame) -> DataFrame:
    """``rows`` (user_id, id, created_at and more) with each one's place in its user's list, newest first, and its page.
    """
    placed = places_within(rows, "user_id", [F.col("created_at").desc(), F.col("id").desc()])
    return placed.withColumn("page", F.ceil(F.col("pos") / S.PAGE_SIZE).cast("long"))


def category_options(complaints: DataFrame, domains: DataFrame, categories: DataFrame) -> DataFrame:
    """Per domain in use, its categories with their place in the listing (by name) and the number of complaints they are offered to."""
    used = complaints.groupBy("domain_id").agg(F.count("*").alias("n_complaints"))
    d = domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain"))
    c = categories.select("domain_id", F.col("id").alias("category_id"), F.col("name").alias("category"), "sla_hours")
    place = F.row_number().over(Window.partitionBy("domain_id").orderBy("category", "category_id")).cast("long")
    return used.join(d, "domain_id").join(c.withColumn("place", place), "domain_id").select(
        "domain", "place", "category", "category_id", "sla_hours", "n_complaints"
    )


def complaint_history(events: DataFrame, users: DataFrame, predictions: DataFrame) -> DataFrame:
    """Audit trail with actor and prediction; both may be gone."""
    u = users.select(F.col("id").alias("_actor"), F.col("username").alias("actor"))
    p = predictions.select(F.col("id").alias("_prediction"), F.col("kind").alias("prediction_kind"), "model_version")
    keyed = events.withColumns({"_actor": join_key(F.col("actor_id"), F.col("id")), "_prediction": join_key(F.col("prediction_id"), F.col("id"))})
    return keyed.join(u, "_actor", "left").join(p, "_prediction", "left").select(
        F.col("id").alias("event_id"), "complaint_id", "kind", S.label(F.col("kind"), S.EVENT_KINDS).alias("kind_label"),
        "from_value", "to_value", "actor", "prediction_kind", "model_version", "note", "created_at",
    )


def transition_matrix(complaints: DataFrame) -> DataFrame:
    """Every (from, to) pair of statuses, its legality, and how many complaints stand before it."""
    here = complaints.groupBy("status").agg(F.count("*").alias("n_complaints"))
    sources = here.sparkSession.createDataFrame([(s,) for s in S.STATUSES], "status STRING")
    return (
        sources.join(here, "status", "left")
        .select("status", F.coalesce("n_complaints", F.lit(0)).alias("n_complaints"), F.explode(F.array(*map(F.lit, S.STATUSES))).alias("to_status"))
        .select(
            F.col("status").alias("from_status"),
            "to_status",
            F.array_contains(F.element_at(S.transition_map(), F.col("status")), F.col("to_status")).alias("allowed"),
            F.col("n_complaints").cast("long").alias("n_complaints"),
        )
    )
