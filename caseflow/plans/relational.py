"""Registered queries over the derived case entities: every operator that has no model in it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions import scalar as fn
from caseflow.operators import access, deletes, duplicates, evaluate, evidence, integrity, keyed, lifecycle, queue, sla
from caseflow.operators.scan import global_position
from caseflow.session import pin
from caseflow.sources import entities as E
from caseflow.sources import packs
from caseflow.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

CONFIDENCE_THRESHOLD = 0.5
RISK_BANDS = {"high": 0.66, "medium": 0.33}
PINNED_VERSIONS = {region: {"risk": "v1"} for region in ("africa", "america", "middle east")} | {
    "asia": {"triage": "v2", "risk": "v1"},
    "europe": {"triage": "v1", "risk": "v1"},
}
FLOORS = {"roc_auc": 0.55, "macro_f1": 0.5, "top3_accuracy": 0.5}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, directory: build(Tables(spark, directory))
    return build


def _grants(t: Tables) -> DataFrame:
    users = E.users(t)
    return access.granted(users, access.with_default_role(users, E.elevated_groups(t)), E.direct_permissions(t))


def _closed(t: Tables) -> DataFrame:
    return E.complaints(t, ["id", "status"]).filter(F.col("status") == "closed").select("id")


# --- scans, sources, sinks ----------------------------------------------------------------------


@query
def scan_complaints(t: Tables) -> DataFrame:
    return E.complaints(t)


@query
def ingest_finance(t: Tables) -> DataFrame:
    return packs.finance_adapter(E.finance_records(t))


@query
def ingest_civic(t: Tables) -> DataFrame:
    return packs.civic_adapter(E.civic_records(t))


def _export_batch(t: Tables) -> DataFrame:
    """Documents as an export whose key is missing now and then."""
    key = F.when(F.col("doc_id") % 97 != 5, F.md5("text"))
    return t.documents.select(key.alias("external_id"), "doc_id", "n_chars", "source")


def _unreadable(raw: DataFrame) -> DataFrame:
    """A raw export some of whose dates are no dates."""
    odd = F.col("Complaint ID").cast("long") % 41
    return raw.withColumn("Date received", F.when(odd == 7, "n/a").when(odd == 8, "2024-02-31").otherwise(F.col("Date received")))


@query
def ingest_idempotent(t: Tables) -> DataFrame:
    batch = _export_batch(t)
    loaded = batch.filter(F.col("source").isin("src0", "src1", "src2"))
    return keyed.ingest_new(batch, loaded, "doc_id").drop("source")


@query
def ingest_rejects(t: Tables) -> DataFrame:
    return keyed.missing_key(_export_batch(t).drop("source"), ["external_id"])


@query
def finance_rejects(t: Tables) -> DataFrame:
    return packs.finance_rejects(_unreadable(E.finance_records(t)))


@query
def finance_tolerant(t: Tables) -> DataFrame:
    return packs.finance_adapter(_unreadable(E.finance_records(t)))


@query
def dataset_hash(t: Tables) -> DataFrame:
    return keyed.dataset_hash(t.documents, ["doc_id", "text", "lang", "source"])


def _keyed_intake(t: Tables) -> DataFrame:
    accepted = keyed.validate_intake(E.intake_requests(t), E.domains(t)).filter("accepted")
    return accepted.withColumn("submitted_by", F.when(F.col("id") % 29 != 3, F.col("submitted_by")))


@query
def upsert_rejects(t: Tables) -> DataFrame:
    return keyed.missing_key(_keyed_intake(t).select("id", "title", "submitted_by"), ["title", "submitted_by"])


@query
def upsert_if_absent(t: Tables) -> DataFrame:
    accepted = _keyed_intake(t)
    target = accepted.filter(F.col("domain_id") <= 1).select("id", "title", "submitted_by")
    return keyed.insert_if_absent(target, accepted.select("id", "title", "submitted_by"), ["title", "submitted_by"], "id")


@query
def append_conflicts(t: Tables) -> DataFrame:
    """A batch that holds some ids twice, and many that are stored already."""
    incoming = E.complaints(t, ["id", "category_slug"]).filter(F.col("category_slug").isNotNull()).select((F.col("id") * 10 + F.when(F.col("id") % 3 == 0, 1).otherwise(9)).alias("id"))
    incoming = incoming.unionByName(incoming.filter(F.col("id") % 50 == 19))
    return keyed.append_conflicts(E.predictions(t), incoming)


@query
def cascade_delete(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    gone = stored.filter(F.col("status") == "closed").select("id")
    parts = [
        keyed.cascade_delete(child.select("id", "complaint_id"), "complaint_id", gone).withColumn("child", F.lit(name))
        for name, child in (("event", E.history(t, stored)), ("prediction", E.predictions(t, stored)))
    ]
    return parts[0].unionByName(parts[1])


@query
def delete_effects(t: Tables) -> DataFrame:
    """What deleting the inactive domains, the closed complaints and the users with a negative balance would do."""
    stored = E.stored_complaints(t)
    tables = {
        "domain": E.domains(t), "category": E.categories(t), "user": E.users(t), "complaint": stored, "event": E.history(t, stored), "prediction": E.predictions(t, stored),
    }
    gone = {
        "domain": E.domains(t).filter("NOT is_active"), "complaint": stored.filter(F.col("status") == "closed"),
        "user": t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id")),
    }
    return deletes.plan_deletes(tables, {name: df.select("id") for name, df in gone.items()}).summary()


@query
def set_null_on_delete(t: Tables) -> DataFrame:
    rows = E.complaints(t, ["id", "assignee_id", "duplicate_of"])
    gone_users = t.customer.filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    return keyed.set_null_on_delete(keyed.set_null_on_delete(rows, "assignee_id", gone_users), "duplicate_of", _closed(t))


@query
def protected_delete(t: Tables) -> DataFrame:
    rows = E.complaints(t, ["submitted_by", "category_id", "domain_id"])
    checks = (("user", E.users(t), "submitted_by"), ("category", E.categories(t), "category_id"), ("domain", E.domains(t), "domain_id"))
    parts = [keyed.protected_delete(df.select("id"), rows, c).withColumn("entity", F.lit(name)) for name, df, c in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def pack_categories(t: Tables) -> DataFrame:
    used = [
        packs.pack_for(slug).adapter(raw).groupBy(F.col("category_label").alias("category_name")).agg(F.count("*").alias("n")).withColumn("domain_slug", F.lit(slug))
        for slug, raw in (("cfpb", E.finance_records(t)), ("nyc311", E.civic_records(t)))
    ]
    return packs.pack_categories(t.spark).join(used[0].unionByName(used[1]), ["domain_slug", "category_name"], "left").select(
        "domain_slug", "category_slug", "category_name", "sla_hours", F.coalesce("n", F.lit(0)).cast("long").alias("n_records")
    )


# --- views and predicates -----------------------------------------------------------------------


@query
def complaint_view(t: Tables) -> DataFrame:
    return queue.complaint_view(E.complaints(t, [*E.CORE_COLUMNS, "title", "body"]), E.users(t), E.as_of())


@query
def overdue(t: Tables) -> DataFrame:
    return queue.overdue(E.complaints(t, ["id", "status", "due_at", "resolved_at"]), E.as_of()).drop("resolved_at")


@query
def my_complaints(t: Tables) -> DataFrame:
    """Everyone's own complaints, those of agents too, who see all others besides."""
    viewers = E.users(t).select(F.col("id").alias("user_id"))
    rows = access.visible_rows(E.complaints(t, ["id", "domain_id", "status", "submitted_by", "created_at"]), viewers)
    return queue.own_list(rows.select("user_id", "id", "domain_id", "status", "created_at")).drop("created_at")


@query
def agent_queue(t: Tables) -> DataFrame:
    return queue.agent_queue(E.complaints(t), E.domains(t), E.as_of())


@query
def intake_validate(t: Tables) -> DataFrame:
    return keyed.validate_intake(E.intake_requests(t), E.domains(t))


@query
def triage_validate(t: Tables) -> DataFrame:
    checked = keyed.validate_triage(E.commands(t), E.categories(t)).filter(F.col("op") == "triage")
    return checked.select("seq", "complaint_id", "category_id", "priority", "refusal")


@query
def unknown_refs(t: Tables) -> DataFrame:
    c, m = E.damaged(E.stored_complaints(t)), E.commands(t)
    key = F.col("id")
    return keyed.unknown_refs({
        "assignee": (c, F.col("assignee_id"), E.users(t), key),
        "canonical": (m, F.col("canonical_id"), m, F.col("complaint_id")),
        "category": (c, F.col("category_id"), E.categories(t), key),
        "domain": (c, F.col("domain_id"), E.domains(t), key),
        "duplicate_of": (c, F.col("duplicate_of"), c, key),
    })


@query
def category_options(t: Tables) -> DataFrame:
    return queue.category_options(E.complaints(t, ["domain_id"]), E.domains(t), E.categories(t))


@query
def legal_actions(t: Tables) -> DataFrame:
    return queue.legal_actions(E.complaints(t, ["id", "status", "submitted_by"]), access.permission_flags(_grants(t)))


@query
def event_order(t: Tables) -> DataFrame:
    """The default order of a complaint's history: oldest first."""
    history = E.history(t, E.stored_complaints(t)).select("id", "complaint_id", "created_at")
    return queue.places_within(history, "complaint_id", [F.col("created_at"), F.col("id")]).drop("created_at")


@query
def prediction_order(t: Tables) -> DataFrame:
    """The default order of predictions: newest first."""
    rows = E.predictions(t, E.stored_complaints(t)).select("id", "complaint_id", "kind", "created_at")
    return global_position(rows, [F.col("created_at").desc(), F.col("id").desc()]).drop("created_at")


@query
def domain_order(t: Tables) -> DataFrame:
    """The default order of domains: by name."""
    return global_position(E.domains(t).select("id", "slug", "name"), [F.col("name"), F.col("id")])


@query
def viewer_actions(t: Tables) -> DataFrame:
    """Every user as a viewer, of complaints of others too where they may see them."""
    grants = _grants(t)
    viewers, agents = E.users(t).select(F.col("id").alias("user_id")), access.holders(grants, access.VIEW_QUEUE)
    return queue.viewer_actions(E.complaints(t, ["status", "submitted_by"]), viewers, access.permission_flags(grants), agents)


@query
def queue_display(t: Tables) -> DataFrame:
    return queue.queue_display(E.complaints(t), E.domains(t), E.categories(t), E.users(t), E.as_of())


@query
def intake_defaults(t: Tables) -> DataFrame:
    return keyed.new_complaints(keyed.validate_intake(E.intake_requests(t), E.domains(t)).filter("accepted"), E.as_of())


@query
def transition_matrix(t: Tables) -> DataFrame:
    return queue.transition_matrix(E.complaints(t, ["status"]))


@query
def complaint_label(t: Tables) -> DataFrame:
    return E.complaints(t, ["id", "title"]).select("id", fn.complaint_label(F.col("id"), F.col("title")).alias("label"))


@query
def queue_page(t: Tables) -> DataFrame:
    rows = queue.open_queue(E.complaints(t, ["id", "status", "due_at", "created_at"]))
    return queue.page(rows, queue.queue_order(), 3)


@query
def risk_queue(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    risk = evidence.latest_predictions(E.predictions(t, stored).filter(F.col("kind") == "risk"))
    scores = risk.select(F.col("complaint_id").alias("id"), fn.payload_score(F.col("payload")).alias("score"))
    rows = queue.open_queue(stored.select("id", "status", "due_at")).join(scores, "id", "left")
    return global_position(rows, [F.col("score").desc_nulls_last(), F.col("due_at").asc_nulls_first(), F.col("id").asc()])


@query
def page_counts(t: Tables) -> DataFrame:
    return queue.page_counts(E.complaints(t, ["submitted_by"]), E.users(t))


# --- access -------------------------------------------------------------------------------------


@query
def default_role(t: Tables) -> DataFrame:
    return access.with_default_role(E.users(t), E.elevated_groups(t))


@query
def user_permissions(t: Tables) -> DataFrame:
    return _grants(t)


@query
def permission_matrix(t: Tables) -> DataFrame:
    return access.permission_matrix(E.users(t), _grants(t))


@query
def assignable_users(t: Tables) -> DataFrame:
    """With their place in the list, which is by name."""
    return global_position(access.assignable_users(E.users(t), _grants(t)), [F.col("username"), F.col("id")])


def _judged_commands(t: Tables) -> DataFrame:
    """Every command with ``denied`` by its actor; a complaint exists if the customer it belongs to does."""
    owner = F.floor(F.col("complaint_id") / 8).cast("long")
    commands = E.commands(t)
    owners = commands.select("complaint_id", owner.alias("submitted_by")).distinct().join(E.users(t).select(F.col("id").alias("submitted_by")), "submitted_by", "left_semi")
    pool = t.spark.range(5).select(F.concat(F.lit("agent"), F.col("id").cast("string")).alias("assignee"))
    return access.command_access(commands, _grants(t), owners, pool)


@query
def command_access(t: Tables) -> DataFrame:
    return _judged_commands(t).select("seq", "complaint_id", "op", "actor_id", "denied")


@query
def visible_counts(t: Tables) -> DataFrame:
    return access.visible_counts(E.complaints(t, ["submitted_by"]), E.users(t), _grants(t))


# --- evidence -----------------------------------------------------------------------------------


def _judged(t: Tables, *kinds: str) -> DataFrame:
    stored = E.stored_complaints(t)
    # Only these kinds of event answer a prediction, and only these kinds of prediction get a verdict.
    return evidence.verdicts(E.history(t, stored).filter(F.col("kind").isin(*(kinds or ("category", "duplicate")))), E.predictions(t, stored))


@query
def complaint_history(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    return queue.complaint_history(E.history(t, stored), E.users(t), E.predictions(t, stored))


@query
def event_kinds(t: Tables) -> DataFrame:
    return E.history(t).groupBy("complaint_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


@query
def acceptance_verdict(t: Tables) -> DataFrame:
    return _judged(t).select("id", "complaint_id", "kind", "to_value", "prediction_kind", "accepted")


@query
def acceptance_rate(t: Tables) -> DataFrame:
    return evidence.acceptance_rate(_judged(t))


@query
def override_corpus(t: Tables) -> DataFrame:
    return evidence.override_corpus(_judged(t), E.complaints(t, ["id"]), lambda rows: E.with_texts(t, rows, "complaint_id"))


@query
def latest_prediction(t: Tables) -> DataFrame:
    return evidence.latest_predictions(E.predictions(t)).select("complaint_id", "kind", "id", "model_version", "created_at")


@query
def model_registry(t: Tables) -> DataFrame:
    return evidence.model_registry(E.domains(t), PINNED_VERSIONS, E.predictions(t))


@query
def history_replay_diff(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    return evidence.history_replay_diff(E.damaged(stored), E.history(t, stored))


@query
def duplicate_pairs(t: Tables) -> DataFrame:
    return duplicates.duplicate_pairs(E.complaints(t, ["id", "duplicate_of", "status", "domain_id"]))


@query
def triage_abstain(t: Tables) -> DataFrame:
    p = F.from_json("payload", S.TRIAGE_PAYLOAD)
    confidence = p["confidence"]
    return E.predictions(t).filter(F.col("kind") == "triage").select(
        "id", "complaint_id", confidence.alias("confidence"), F.when(confidence >= CONFIDENCE_THRESHOLD, p["category_slug"]).alias("category_slug")
    )


@query
def risk_bands(t: Tables) -> DataFrame:
    from caseflow.models.risk import band

    score = fn.payload_score(F.col("payload"))
    return E.predictions(t).filter(F.col("kind") == "risk").select("complaint_id", score.alias("score"), band(score, RISK_BANDS).alias("band"))


@query
def null_scores(t: Tables) -> DataFrame:
    from caseflow.models.base import with_null_scores

    scored = with_null_scores(E.complaints(t, ["id"]))
    return scored.select(
        "id", "triage.category_slug", "triage.confidence", F.size("matches").cast("long").alias("n_matches"), "risk.score", "risk.band", "risk.model_version"
    )


# --- deadlines and features ---------------------------------------------------------------------


@query
def sla_clock(t: Tables) -> DataFrame:
    return E.complaints(t, ["id", "triaged_at", "sla_hours", "due_at"]).filter(F.col("triaged_at").isNotNull())


@query
def sla_breach_report(t: Tables) -> DataFrame:
    return sla.breach_report(E.complaints(t))


@query
def category_history(t: Tables) -> DataFrame:
    return sla.category_history(E.complaints(t))


@query
def category_history_asof(t: Tables) -> DataFrame:
    return sla.category_history_asof(E.stored_complaints(t))


@query
def queue_depth(t: Tables) -> DataFrame:
    return sla.queue_depth(E.stored_complaints(t))


@query
def assignee_load(t: Tables) -> DataFrame:
    return sla.assignee_load(E.complaints(t, ["assignee_id", "status"]))


@query
def priority_rank(t: Tables) -> DataFrame:
    return E.complaints(t, ["id", "priority"]).withColumn("priority_rank", fn.priority_rank(F.col("priority")))


@query
def submitted_parts(t: Tables) -> DataFrame:
    at = F.col("created_at")
    return E.complaints(t, ["id", "created_at"]).select(
        "id", F.hour(at).cast("long").alias("submitted_hour"), F.weekday(at).cast("long").alias("submitted_weekday"),
        F.round(fn.seconds_between(at, E.as_of()) / 3600, 6).alias("age_hours"),
    )


@query
def text_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.length("text").cast("long").alias("text_length"))


def with_text_lengths(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` with the length of each complaint's text; only lengths travel through the join."""
    total = t.documents.agg(F.count("*").alias("n")).scalar()
    lengths = t.documents.select("doc_id", F.length("text").alias("text_length"))
    return rows.withColumn("doc_id", F.col("id") % total).join(lengths, "doc_id", "left").drop("doc_id")


_RISK_NEEDS = ["id", "domain_id", "category_id", "sla_hours", "priority", "status", "assignee_id", "created_at", "triaged_at", "due_at", "resolved_at"]


def risk_rows(t: Tables, carried: Sequence[str] = ()) -> DataFrame:
    """The risk features with further columns of the complaints, all taken along by the one pass that derives the complaints."""
    return sla.risk_features(pin(with_text_lengths(t, E.complaints(t, [*_RISK_NEEDS, *carried])), "complaints"), carried)


@query
def risk_features(t: Tables) -> DataFrame:
    return risk_rows(t)


@query
def holdout_split(t: Tables) -> DataFrame:
    from caseflow.models.base import split_of

    return t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"))


# --- lifecycle ----------------------------------------------------------------------------------


def _lifecycle(t: Tables) -> lifecycle.Lifecycle:
    known = E.commands(t).groupBy("complaint_id").agg(F.min("domain_id").alias("domain_id"))
    return lifecycle.run(E.commands(t), E.categories(t), known)


@query
def lifecycle_state(t: Tables) -> DataFrame:
    return _lifecycle(t).state().drop("duplicate_of")


@query
def lifecycle_events(t: Tables) -> DataFrame:
    return _lifecycle(t).events().drop("prediction_id")


@query
def lifecycle_refusals(t: Tables) -> DataFrame:
    return _lifecycle(t).refusals()


@query
def lifecycle_duplicates(t: Tables) -> DataFrame:
    return _lifecycle(t).state()


@query
def duplicate_refusals(t: Tables) -> DataFrame:
    return _lifecycle(t).refusals().filter(F.col("op") == "mark_duplicate")


def _authorised(t: Tables) -> lifecycle.Lifecycle:
    known = E.commands(t).groupBy("complaint_id").agg(F.min("domain_id").alias("domain_id"))
    return lifecycle.run_authorised(_judged_commands(t), E.categories(t), known)


@query
def authorised_state(t: Tables) -> DataFrame:
    """The lifecycle of permitted commands only."""
    return _authorised(t).state()


@query
def authorised_refusals(t: Tables) -> DataFrame:
    """Commands that were denied, and permitted ones that the lifecycle refused."""
    return _authorised(t).refusals()


@query
def retriage_due(t: Tables) -> DataFrame:
    valid = keyed.validate_triage(E.commands(t), E.categories(t)).filter((F.col("op") == "triage") & F.col("refusal").isNull())
    first = valid.groupBy("complaint_id").agg(F.min("ts").alias("triaged_at"))
    return valid.join(first, "complaint_id").select("seq", "complaint_id", "triaged_at", fn.due_at(F.col("triaged_at"), F.col("sla_hours")).alias("due_at"))


@query
def canonical_root(t: Tables) -> DataFrame:
    """Chains of the damaged links, with cycles of two put in and a row that leads to each."""
    place, link = F.col("id") % 1000, F.col("id")
    looped = F.when(place == 0, link + 1).when(place.isin(1, 2), link - 1).otherwise(F.col("duplicate_of"))
    return duplicates.canonical_roots(E.complaints(t, ["id", "duplicate_of"], dirty=True).withColumn("duplicate_of", looped))


# --- integrity ----------------------------------------------------------------------------------


@query
def integrity_report(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    return integrity.integrity_report(E.damaged(stored), E.domains(t), E.categories(t), E.history(t, stored), E.predictions(t, stored))


@query
def taxonomy_drift(t: Tables) -> DataFrame:
    seeded = E.complaints(t, ["category_id"], dirty=True).filter(F.col("category_id").isNotNull()).distinct()
    return keyed.taxonomy_drift(seeded, E.categories(t).select(F.col("id").alias("category_id")))


# --- evaluation ---------------------------------------------------------------------------------


def _graded(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    stored = E.stored_complaints(t) if stored is None else stored
    answers = evidence.latest_predictions(E.predictions(t, stored)).filter(F.col("kind") == "triage").select(
        F.col("complaint_id").alias("id"), fn.payload_slug(F.col("payload")).alias("predicted")
    )
    return answers.join(stored.select("id", "category_slug").withColumnRenamed("category_slug", "label"), "id")


def _ranked(t: Tables, stored: DataFrame | None = None) -> DataFrame:
    stored = E.stored_complaints(t) if stored is None else stored
    scores = E.predictions(t, stored).filter(F.col("kind") == "risk").select(F.col("complaint_id").alias("id"), fn.payload_score(F.col("payload")).alias("score"))
    labels = stored.filter(F.col("resolved_at").isNotNull()).select("id", fn.is_breach().alias("label"))
    return scores.join(labels, "id")


def _shortlists(t: Tables) -> DataFrame:
    """Each triaged complaint's five slugs, rotated by its id."""
    slugs = F.array(*map(F.lit, E.SEGMENTS))
    shift = (F.col("id") % 5).cast("int")
    ranked = F.concat(F.slice(slugs, shift + 1, 5), F.slice(slugs, 1, F.greatest(shift, F.lit(0))))
    return E.complaints(t, ["id", "category_slug"]).filter(F.col("category_slug").isNotNull()).select("id", F.col("category_slug").alias("label"), ranked.alias("ranked"))


@query
def confusion_matrix(t: Tables) -> DataFrame:
    return evaluate.confusion_matrix(_graded(t))


@query
def class_metrics(t: Tables) -> DataFrame:
    return evaluate.class_metrics(_graded(t))


@query
def macro_f1(t: Tables) -> DataFrame:
    return evaluate.macro_f1(_graded(t))


@query
def top3_accuracy(t: Tables) -> DataFrame:
    return evaluate.top_n_accuracy(_shortlists(t), 3, "top3_accuracy")


@query
def baselines(t: Tables) -> DataFrame:
    return evaluate.baselines(_graded(t))


@query
def roc_auc(t: Tables) -> DataFrame:
    return evaluate.roc_auc(_ranked(t))


@query
def precision_at_k(t: Tables) -> DataFrame:
    return evaluate.precision_at_k(_ranked(t), [10, 100, 1000])


@query
def calibration_curve(t: Tables) -> DataFrame:
    return evaluate.calibration_curve(_ranked(t))


@query
def metric_floor(t: Tables) -> DataFrame:
    stored = E.stored_complaints(t)
    return evaluate.metric_floor(
        {"roc_auc": evaluate.roc_auc(_ranked(t, stored)), "macro_f1": evaluate.macro_f1(_graded(t, stored)), "top3_accuracy": evaluate.top_n_accuracy(_shortlists(t), 3, "top3_accuracy").select("top3_accuracy")},
        FLOORS,
    )
