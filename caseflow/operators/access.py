"""Role bundles, permission tests and row visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import schema as S

VIEW_QUEUE = "complaints.view_queue"
FLAG_PERMISSIONS = {
    "can_triage": "complaints.triage_complaint",
    "can_assign": "complaints.assign_complaint",
    "can_mark_duplicate": "complaints.mark_duplicate",
    "can_resolve": "complaints.resolve_complaint",
}


def group_permissions(spark: SparkSession) -> DataFrame:
    """(group_name, permission): each bundle is its parent's plus its own extras."""
    rows = [(role, p) for role in S.ROLE_EXTRAS for p in S.role_bundle(role)]
    return spark.createDataFrame(rows, "group_name STRING, permission STRING").distinct()


def with_default_role(users: DataFrame, user_groups: DataFrame) -> DataFrame:
    """An account without any role row starts as Submitter."""
    fresh = users.select(F.col("id").alias("user_id")).join(user_groups, "user_id", "left_anti")
    return user_groups.select("user_id", "group_name").unionByName(
        fresh.select("user_id", F.lit("Submitter").alias("group_name"))
    )


def granted(users: DataFrame, user_groups: DataFrame, direct: DataFrame) -> DataFrame:
    """Distinct (user_id, permission) from roles, direct grants and the superuser flag."""
    spark = users.sparkSession
    via_role = user_groups.join(group_permissions(spark), "group_name").select("user_id", "permission")
    everything = F.explode(F.array(*map(F.lit, S.ALL_PERMISSIONS)))
    via_super = users.filter("is_superuser").select(F.col("id").alias("user_id"), everything.alias("permission"))
    return via_role.unionByName(direct.select("user_id", "permission")).unionByName(via_super).distinct()


def permission_matrix(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Per user and permission, the answer to the permission test; negatives included."""
    asked = users.select(
        F.col("id").alias("user_id"), F.explode(F.array(*map(F.lit, S.ALL_PERMISSIONS))).alias("permission")
    )
    held = grants.withColumn("held", F.lit(True))
    return asked.join(held, ["user_id", "permission"], "left").select(
        "user_id", "permission", F.coalesce("held", F.lit(False)).alias("granted")
    )


def permission_flags(grants: DataFrame) -> DataFrame:
    """One row per user with the action permissions as columns."""
    return grants.groupBy("user_id").agg(
        *[F.bool_or(F.col("permission") == p).alias(flag) for flag, p in FLAG_PERMISSIONS.items()]
    )


def holders(grants: DataFrame, permission: str) -> DataFrame:
    return grants.filter(F.col("permission") == permission).select("user_id")


def assignable_users(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Whoever may see the queue may be assigned to a complaint."""
    pool = holders(grants, VIEW_QUEUE)
    return users.join(pool, users["id"] == pool["user_id"], "left_semi").select("id", "username")


def command_access(commands: DataFrame, grants: DataFrame, complaints: DataFrame, assignees: DataFrame) -> DataFrame:
    """``commands`` with ``denied``, why a command may not even be tried: permission first, then visibility, then unknown references.

    ``complaints`` (complaint_id, submitted_by) are the existing ones, ``assignees`` (assignee) who may be assigned. What an
    actor can't see is to them as unknown as what doesn't exist. Pass on the commands with no ``denied`` to the lifecycle.
    """
    op, to = F.col("op"), F.col("to_status")
    needed = (
        F.when((op == "triage") | ((op == "transition") & to.isin("in_review", "in_progress")), FLAG_PERMISSIONS["can_triage"])
        .when(op == "assign", FLAG_PERMISSIONS["can_assign"])
        .when(op == "mark_duplicate", FLAG_PERMISSIONS["can_mark_duplicate"])
        .otherwise(FLAG_PERMISSIONS["can_resolve"])
    )
    held = grants.groupBy(F.col("user_id").alias("actor_id")).agg(F.collect_set("permission").alias("_held"))  # a few names per user
    known = complaints.select("complaint_id", F.col("submitted_by").alias("_owner")).distinct()
    pool = assignees.select("assignee", F.lit(True).alias("_assignable")).distinct()
    # Commands without an assignee get one of many names that nobody has, so they don't meet in one task.
    nobody = F.concat(F.lit("\0"), F.pmod(F.xxhash64("seq"), F.lit(1 << 20)).cast("string"))
    rows = commands.withColumn("_key", F.coalesce("assignee", nobody))
    rows = rows.join(held, "actor_id", "left").join(known, "complaint_id", "left").join(pool.withColumnRenamed("assignee", "_key"), "_key", "left")
    may = lambda permission: F.coalesce(F.array_contains("_held", permission), F.lit(False))
    sees = may(F.lit(VIEW_QUEUE)) | (F.col("_owner") == F.col("actor_id"))
    denied = (
        F.when(~may(needed), "forbidden")
        .when(F.col("_owner").isNull() | ~sees, "not_found")
        .when((op == "assign") & F.col("_assignable").isNull(), "unknown_assignee")
    )
    return rows.withColumn("denied", denied).drop("_key", "_held", "_owner", "_assignable")


def visible_rows(complaints: DataFrame, viewers: DataFrame) -> DataFrame:
    """(viewer, complaint) pairs of viewers limited to their own rows."""
    return viewers.join(complaints, viewers["user_id"] == complaints["submitted_by"])


def visible_counts(complaints: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """How many complaints each user can see; the pairs themselves are never formed."""
    own = complaints.groupBy(F.col("submitted_by").alias("id")).agg(F.count("*").alias("own"))
    total = complaints.agg(F.count("*").alias("n")).scalar()
    agents = holders(grants, VIEW_QUEUE).select(F.col("user_id").alias("id"), F.lit(True).alias("sees_all"))
    sees_all = F.coalesce("sees_all", F.lit(False))
    return users.join(own, "id", "left").join(agents, "id", "left").select(
        F.col("id").alias("user_id"),
        sees_all.alias("sees_all"),
        F.when(sees_all, total).otherwise(F.coalesce("own", F.lit(0))).cast("long").alias("n_visible"),
    )
