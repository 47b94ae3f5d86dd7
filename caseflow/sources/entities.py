"""Case entities derived from the supplied star schema (the rules are listed in FIXTURES.md, part 3).

Every function declares only the joins its requested columns need, so a query that asks for
``priority`` scans ``orders`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import due_at, hours
from caseflow.session import pin
from caseflow.sources.tables import Tables


def as_of() -> Column:
    """The fixed clock of all checked queries."""
    return F.lit("2001-08-03 00:00:00").cast("timestamp_ntz")


# market segment -> (category number inside its domain, sla_hours)
SEGMENTS = {
    "automobile": (1, 48),
    "building": (2, 72),
    "furniture": (3, 96),
    "household": (4, 120),
    "machinery": (5, 24),
}
ORDER_PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "5-LOW": "low"}

_DOMAIN_COLUMNS = {"domain_id", "category_slug", "category_id", "sla_hours", "due_at"}
_LINE_COLUMNS = {"status", "resolved_at", "assignee_id", "untimely"}
_FIRST_COLUMNS = _LINE_COLUMNS | {"duplicate_of"}
_TEXT_COLUMNS = {"title", "body"}
CORE_COLUMNS = [
    "id", "domain_id", "category_id", "category_slug", "sla_hours", "priority", "status", "submitted_by",
    "assignee_id", "duplicate_of", "created_at", "triaged_at", "due_at", "resolved_at",
]
# Days after which a line still to be shipped makes a complaint's order untimely, an outcome apart from the complaint's own dates.
UNTIMELY_DAYS = 90
# Columns the dirty variant looks at or overwrites.
_DIRTY_NEEDS = {"status", "duplicate_of", "due_at", "category_id", "priority", "assignee_id"}


def domains(t: Tables) -> DataFrame:
    return t.region.select(
        F.col("r_regionkey").cast("long").alias("id"),
        F.lower("r_name").alias("slug"),
        F.col("r_name").alias("name"),
        (F.col("r_regionkey") != 4).alias("is_active"),
    )


def categories(t: Tables) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(slug).alias("slug"), F.lit(n).alias("n"), F.lit(sla).alias("sla_hours"))
        for slug, (n, sla) in SEGMENTS.items()
    ])
    return t.region.select(F.col("r_regionkey").cast("long").alias("domain_id"), F.explode(rows).alias("c")).select(
        (F.col("domain_id") * 10 + F.col("c.n")).alias("id"),
        "domain_id",
        F.col("c.slug").alias("slug"),
        F.upper("c.slug").alias("name"),
        F.col("c.sla_hours").alias("sla_hours"),
    )


def stored_complaints(t: Tables) -> DataFrame:
    """The complaint table written once, for queries that look at it from several sides."""
    return pin(complaints(t), "complaints")


def damaged(stored: DataFrame) -> DataFrame:
    """``stored`` with rows that break the audited rules."""
    return _damage(stored)


def complaints(t: Tables, columns: Sequence[str] | None = None, dirty: bool = False) -> DataFrame:
    columns = list(columns or CORE_COLUMNS)
    need = set(columns) | (_DIRTY_NEEDS if dirty else set())
    triaged = F.col("priority").isNotNull()

    df = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("submitted_by"),
        F.col("o_orderstatus"),
        F.col("o_orderdate"),
        F.element_at(S.literal_map(ORDER_PRIORITY), F.col("o_orderpriority")).alias("priority"),
        (F.col("o_orderdate") + hours(F.col("o_orderkey") % 24)).alias("created_at"),
    ).withColumn("triaged_at", F.when(triaged, F.col("created_at") + hours(F.col("id") % 48)))

    if need & _DOMAIN_COLUMNS:
        place = t.customer.select(
            F.col("c_custkey").alias("submitted_by"), "c_nationkey", F.lower("c_mktsegment").alias("segment")
        ).join(
            t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("domain_id")),
            "c_nationkey",
            "left",
        ).drop("c_nationkey")
        number = F.element_at(S.literal_map({k: v[0] for k, v in SEGMENTS.items()}), F.col("category_slug"))
        sla = F.element_at(S.literal_map({k: v[1] for k, v in SEGMENTS.items()}), F.col("category_slug"))
        df = (
            df.join(place, "submitted_by", "left")
            .withColumn("category_slug", F.when(triaged, F.col("segment")))
            .withColumns({"category_id": F.col("domain_id") * 10 + number, "sla_hours": sla})
            .withColumn("due_at", due_at(F.col("triaged_at"), F.col("sla_hours")))
        )
    if need & _FIRST_COLUMNS:
        firsts = t.orders.groupBy(F.col("o_custkey").alias("submitted_by")).agg(F.min("o_orderkey").alias("first_id"))
        repeated = (F.col("id") % 17 == 0) & (F.col("id") != F.col("first_id"))
        df = df.join(firsts, "submitted_by", "left").withColumn("duplicate_of", F.when(repeated, F.col("first_id")))
    if need & _LINE_COLUMNS:
        lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.sum("l_quantity").alias("quantity"), F.min("l_suppkey").alias("first_supplier"),
            F.max("l_shipdate").alias("last_shipped"),
        )
        finished = (F.col("o_orderstatus") == "F") & F.col("quantity").isNotNull()
        status = (
            F.when(F.col("duplicate_of").isNotNull(), "duplicate")
            .when(~triaged, "submitted")
            .when(finished, F.when(F.col("id") % 2 == 0, "closed").otherwise("resolved"))
            .when(F.col("o_orderstatus") == "P", "in_progress")
            .otherwise("in_review")
        )
        df = (
            df.join(lines, "id", "left")
            .withColumn("status", status)
            .withColumn(
                "resolved_at",
                F.when(F.col("status").isin("resolved", "closed"), F.col("triaged_at") + hours(F.col("quantity"))),
            )
            .withColumn(
                "assignee_id",
                F.when(F.col("status").isin("in_progress", "resolved", "closed"), F.col("first_supplier")),
            )
            .withColumn("untimely", F.datediff("last_shipped", "o_orderdate") > UNTIMELY_DAYS)
        )
    if need & _TEXT_COLUMNS:
        df = with_texts(t, df)
    if dirty:
        df = _damage(df)
    return df.select(*columns)


def with_texts(t: Tables, rows: DataFrame, complaint: str = "id") -> DataFrame:
    """``rows`` with the title and body of the complaint in column ``complaint``."""
    total = t.documents.agg(F.count("*").alias("n")).scalar()
    texts = t.documents.select("doc_id", title_of(F.col("text")).alias("title"), F.col("text").alias("body"))
    return rows.withColumn("doc_id", F.col(complaint) % total).join(texts, "doc_id", "left")


def title_of(text: Column) -> Column:
    return F.substring(F.substring_index(text, "\n", 1), 1, S.TITLE_MAX)


def _damage(df: DataFrame) -> DataFrame:
    """Rows that break every audited rule, for the integrity queries."""
    cid = F.col("id")
    chain = cid.between(1, 20)
    previous = (cid % 107 == 0) & (cid >= 2)
    hit = (cid > 0) & ((cid % 101 == 0) | (cid % 103 == 0) | previous | chain)
    target = (
        F.when(cid % 101 == 0, F.lit(None).cast("long"))
        .when(cid % 103 == 0, cid)
        .otherwise(cid - 1)
    )
    marked = hit & ((cid % 101 == 0) | (cid % 103 != 0))
    return df.withColumns({
        "status": F.when(marked, "duplicate").otherwise(F.col("status")),
        "duplicate_of": F.when(hit, target).otherwise(F.col("duplicate_of")),
        "due_at": F.when(cid % 109 == 0, F.col("due_at") + hours(1)).otherwise(F.col("due_at")),
        "category_id": F.when(cid % 113 == 0, F.col("category_id") + 10).otherwise(F.col("category_id")),
        "priority": F.when(cid % 127 == 0, "urgent").otherwise(F.col("priority")),
        "assignee_id": F.when(cid % 131 == 0, F.col("assignee_id") + 1_000_000_000).otherwise(F.col("assignee_id")),
    })


# --- accounts ---------------------------------------------------------------------------------


def users(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        (F.col("c_custkey") == 0).alias("is_superuser"),
    )


def elevated_groups(t: Tables) -> DataFrame:
    """Roles granted on purpose; everybody else has no role row yet."""
    slot = F.col("c_custkey") % 20
    return t.customer.filter(slot <= 3).select(
        F.col("c_custkey").alias("user_id"), F.when(slot == 0, "Admin").otherwise("Agent").alias("group_name")
    )


def direct_permissions(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_custkey") % 97 == 0).select(
        F.col("c_custkey").alias("user_id"), F.lit("complaints.view_queue").alias("permission")
    )


# --- model evidence ---------------------------------------------------------------------------

_PREDICTION_NEEDS = ["id", "domain_id", "category_slug", "duplicate_of", "created_at", "triaged_at", "due_at", "resolved_at"]


def suggested_slug() -> Column:
    slot = F.col("id") % 10
    slugs = F.array(*map(F.lit, SEGMENTS))
    other = F.element_at(slugs, (F.col("id") % 5 + 1).cast("int"))
    return F.when(slot < 6, F.col("category_slug")).when(slot < 9, other)


def risk_score_value() -> Column:
    return ((F.col("id") * 7919) % 1000) / 1000


def _json_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))


def predictions(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    """``stored`` saves deriving the complaints again where a query has them already."""
    cid, triaged = F.col("id"), F.col("category_slug").isNotNull()
    confidence = (cid % 100) / 100
    triage_payload = F.concat(
        F.lit('{"category_slug": '), _json_text(suggested_slug()), F.lit(', "confidence": '), confidence.cast("string"), F.lit("}")
    )
    match = F.when(
        cid % 4 != 0,
        F.concat(F.lit('{"complaint_id": '), F.col("duplicate_of").cast("string"), F.lit(', "similarity": 0.95}')),
    ).otherwise(F.concat(F.lit('{"complaint_id": '), (cid + 1).cast("string"), F.lit(', "similarity": 0.8}')))
    risk_payload = F.concat(
        F.lit('{"band": "'), F.when(risk_score_value() >= 0.66, "high").when(risk_score_value() >= 0.33, "medium").otherwise("low"),
        F.lit('", "score": '), risk_score_value().cast("string"), F.lit("}"),
    )
    later = F.col("created_at") + hours(1)

    def row(offset: int, kind: str, payload: Column, version: Column, at: Column, when: Column) -> Column:
        return F.when(when, F.struct(
            (cid * 10 + offset).alias("id"), F.lit(kind).alias("kind"), payload.alias("payload"),
            F.lit(f"{kind}-model").alias("model_name"), version.alias("model_version"), at.alias("created_at"),
        ))

    scored = triaged & (cid % 3 != 0)
    version = F.when(cid % 2 == 0, "v1").otherwise("v2")
    rows = F.array(
        row(1, "triage", triage_payload, version, later, scored),
        row(2, "dedup", F.concat(F.lit('{"matches": ['), match, F.lit("]}")), F.lit("v1"), later, F.col("duplicate_of").isNotNull()),
        row(3, "risk", risk_payload, F.lit("v1"), F.col("triaged_at"), triaged),
        # An older answer of an earlier model; every other one shares its successor's timestamp.
        row(4, "triage", triage_payload, F.lit("v0"), F.when(cid % 10 == 0, later).otherwise(F.col("created_at")), scored & (cid % 5 == 0)),
    )
    return (
        (complaints(t, _PREDICTION_NEEDS) if stored is None else stored)
        .select(cid.alias("complaint_id"), "domain_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("p"))
        .select("p.id", "complaint_id", "domain_id", "p.kind", "p.payload", "p.model_name", "p.model_version", "p.created_at")
    )


_HISTORY_NEEDS = ["id", "domain_id", "category_slug", "priority", "status", "submitted_by", "duplicate_of", "created_at", "triaged_at", "resolved_at"]


def history(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    """The audit trail that the complaints' stored state implies."""
    cid, status = F.col("id"), F.col("status")
    triaged = F.col("category_slug").isNotNull()
    dup = F.col("duplicate_of").isNotNull()
    worked = status.isin("in_progress", "resolved", "closed")
    linked = F.when(cid % 3 != 0, cid * 10 + 1).when(cid % 29 == 0, cid * 10 + 3)
    no_text, no_id = F.lit(None).cast("string"), F.lit(None).cast("long")

    def row(n: int, kind: str, old: Column, new: Column, at: Column, when: Column, prediction: Column = no_id, note: str = "") -> Column:
        return F.when(when, F.struct(
            (cid * 10 + n).alias("id"), F.lit(kind).alias("kind"), old.cast("string").alias("from_value"),
            new.cast("string").alias("to_value"), prediction.cast("long").alias("prediction_id"),
            F.lit(note).alias("note"), at.alias("created_at"),
        ))

    started, finished = F.col("triaged_at") + hours(1), F.col("resolved_at")
    marked = F.coalesce(F.col("triaged_at"), F.col("created_at")) + hours(72)
    rows = F.array(
        row(1, "category", no_text, F.col("category_slug"), F.col("triaged_at"), triaged, linked),
        row(2, "priority", no_text, F.col("priority"), F.col("triaged_at"), triaged),
        row(3, "status", F.lit("submitted"), F.lit("in_review"), F.col("triaged_at"), triaged, note="Triaged"),
        row(4, "status", F.lit("in_review"), F.lit("in_progress"), started, worked),
        row(5, "status", F.lit("in_progress"), F.lit("resolved"), F.greatest(finished, started), finished.isNotNull()),
        row(6, "status", F.lit("resolved"), F.lit("closed"), F.greatest(finished, started) + hours(1), status == "closed"),
        row(7, "status", F.when(triaged, "in_review").otherwise("submitted"), F.lit("duplicate"), marked, dup),
        row(8, "duplicate", no_text, F.col("duplicate_of"), marked, dup, cid * 10 + 2),
    )
    actor = F.when(cid % 11 != 0, F.col("submitted_by"))
    return (
        (complaints(t, _HISTORY_NEEDS) if stored is None else stored)
        .select(cid.alias("complaint_id"), "domain_id", actor.alias("actor_id"),
                F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e"))
        .select("e.id", "complaint_id", "domain_id", "e.kind", "e.from_value", "e.to_value", "actor_id", "e.prediction_id", "e.note", "e.created_at")
    )


# --- commands ---------------------------------------------------------------------------------


def commands(t: Tables, with_duplicates: bool = True) -> DataFrame:
    """One lifecycle command per stream event."""
    k = F.get_json_object("props", "$.k").cast("long")
    cid = F.col("user_id") * 8 + F.col("event_id") % 8
    domain, kind = F.col("domain_id"), F.col("event_type")
    marks = (kind == "error") & (F.col("k") < 15)
    df = (
        t.events.select("event_id", "ts", "event_type", cid.alias("complaint_id"), k.alias("k"))
        .withColumn("domain_id", F.col("complaint_id") % 5)
    )
    if not with_duplicates:
        df = df.filter(~marks)
    foreign = F.when(F.col("k") >= 90, (domain + 1) % 5).otherwise(domain)
    number = F.col("k") % 5 + 1
    ranked = F.element_at(F.array(*map(F.lit, S.PRIORITIES)), (F.col("k") % 4 + 1).cast("int"))
    return df.select(
        F.col("event_id").alias("seq"),
        "ts",
        "complaint_id",
        "domain_id",
        F.when(kind == "view", "triage").when(marks, "mark_duplicate").when(kind == "error", "assign").otherwise("transition").alias("op"),
        F.element_at(S.literal_map({"click": "in_progress", "purchase": "resolved", "signup": "closed"}), kind).alias("to_status"),
        F.when(kind == "view", foreign * 10 + number).alias("category_id"),
        F.when(kind == "view", F.when(F.col("k").between(85, 89), "urgent").otherwise(ranked)).alias("priority"),
        F.when((kind == "error") & (F.col("k") >= 15), F.concat(F.lit("agent"), (F.col("k") % 7).cast("string"))).alias("assignee"),
        F.when(
            marks,
            F.when(F.col("k") < 10, F.col("complaint_id") + 5 * (F.col("k") + 1))
            .when(F.col("k") % 2 == 0, F.col("complaint_id"))
            .otherwise(F.col("complaint_id") + 1),
        ).alias("canonical_id"),
        F.lit(None).cast("long").alias("prediction_id"),
        (F.col("event_id") % 50).alias("actor_id"),
        F.lit("").alias("note"),
    )


# --- raw records ------------------------------------------------------------------------------


def intake_requests(t: Tables) -> DataFrame:
    """Unvalidated submissions: the first line as title, the remaining lines as body."""
    first = F.substring_index("text", "\n", 1)
    return t.documents.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 6).alias("domain_id"),
        first.alias("title"),
        F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)").alias("body"),
        (F.col("doc_id") * 7 % 1000).alias("submitted_by"),
    )


def finance_records(t: Tables) -> DataFrame:
    """Documents under the column names of a consumer-finance export."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("Complaint ID"),
        F.col("text").alias("Consumer complaint narrative"),
        F.element_at(S.literal_map({"en": "Mortgage", "fr": "Credit card", "de": "Debt collection", "es": "Other"}), F.col("lang")).alias("Product"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("Date received"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("Timely response?"),
    )


def civic_records(t: Tables) -> DataFrame:
    """Orders under the column names of a civic service-request export."""
    kinds = F.array(*map(F.lit, ["Noise", "Street condition", "Sanitation", "Other"]))
    form = "MM/dd/yyyy hh:mm:ss a"
    return complaints(t, ["id", "created_at", "resolved_at", "category_slug"]).select(
        F.col("id").cast("string").alias("Unique Key"),
        F.coalesce("category_slug", F.lit("")).alias("Descriptor"),
        F.element_at(kinds, (F.col("id") % 4 + 1).cast("int")).alias("Complaint Type"),
        F.date_format("created_at", form).alias("Created Date"),
        F.date_format("resolved_at", form).alias("Closed Date"),
    )
