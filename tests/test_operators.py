"""Relational operators on hand-made rows, and prefix operators under heavy skew."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions import scalar as fn
from caseflow.models.base import ScorerRegistry, null_risk, null_triage, with_null_scores
from caseflow.operators import access, duplicates, evaluate, evidence, keyed, queue, sla
from caseflow.operators.scan import global_position, last_before, running_totals
from caseflow.session import checkpoint_root, pin, release_pins
from caseflow.sources import packs

T0 = datetime(2024, 1, 1)

# (group, permission, granted), negatives included.
MATRIX = [
    ("Submitter", {"complaints.add_complaint", "complaints.view_complaint"}),
    ("Agent", {"complaints.add_complaint", "complaints.view_complaint", "complaints.view_queue", "complaints.change_complaint", "complaints.triage_complaint",
               "complaints.assign_complaint", "complaints.resolve_complaint", "complaints.mark_duplicate"}),
    ("Admin", set(S.ALL_PERMISSIONS)),
]


def at(hours):
    return T0 + timedelta(hours=hours)


def test_pins_live_in_the_configured_folder(spark):
    path = pin(spark.range(3), "probe").inputFiles()[0]
    assert checkpoint_root(spark) in path


def test_pins_are_deleted_only_on_request(spark, tmp_path):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(pin(spark.range(3), "probe").inputFiles()[0]).path).parent
    assert folder.exists() and release_pins(spark) >= 1 and not folder.exists()
    assert release_pins(spark) == 0


def test_permission_matrix(spark):
    users = spark.createDataFrame([(i, g, False) for i, (g, _) in enumerate(MATRIX)] + [(9, "nobody", False), (10, "root", True)], "id LONG, username STRING, is_superuser BOOLEAN")
    roles = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(MATRIX)], "user_id LONG, group_name STRING")
    direct = spark.createDataFrame([(0, access.VIEW_QUEUE)], "user_id LONG, permission STRING")
    got = {}
    for r in access.permission_matrix(users, access.granted(users, access.with_default_role(users, roles), direct)).collect():
        got.setdefault(r.user_id, {})[r.permission] = r.granted
    for i, (_, held) in enumerate(MATRIX):
        expected = held | ({access.VIEW_QUEUE} if i == 0 else set())
        assert {p for p, ok in got[i].items() if ok} == expected and len(got[i]) == len(S.ALL_PERMISSIONS)
    assert {p for p, ok in got[9].items() if ok} == MATRIX[0][1]  # an account without a role is a Submitter
    assert all(got[10].values())
    pool = access.assignable_users(users, access.granted(users, roles, direct))
    assert {r.username for r in pool.collect()} == {"Submitter", "Agent", "Admin", "root"}


def test_overdue_is_strict_and_stops_at_resolution(spark):
    rows = [(1, at(5), None), (2, at(6), None), (3, at(5), at(7)), (4, None, None)]
    df = spark.createDataFrame(rows, "id LONG, due_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ")
    now = F.lit(at(6)).cast("timestamp_ntz")
    assert [r.id for r in queue.overdue(df, now).collect()] == [1]
    assert df.select(fn.is_overdue(now).alias("o")).filter("o is null").count() == 0


def test_queue_order_puts_untriaged_first(spark):
    rows = [(1, at(9), at(0)), (2, None, at(1)), (3, None, at(2)), (4, at(3), at(0)), (5, at(3), at(1))]
    df = spark.createDataFrame(rows, "id LONG, due_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ")
    assert [r.id for r in global_position(df, queue.queue_order()).orderBy("pos").collect()] == [3, 2, 5, 4, 1]
    assert [r.id for r in queue.page(df, queue.queue_order(), 2, size=2).collect()] == [5, 4]
    deep = queue.page(df, queue.queue_order(), 401, size=2)
    assert deep.count() == 0


def test_verdicts_are_tri_state(spark):
    predictions = spark.createDataFrame([
        (1, "triage", '{"category_slug": "mortgage", "confidence": 0.9}'), (2, "triage", '{"category_slug": null, "confidence": 0.1}'),
        (3, "dedup", '{"matches": [{"complaint_id": 7, "similarity": 0.9}]}'), (4, "dedup", "{}"), (5, "risk", '{"band": "high", "score": 0.8}'),
    ], "id LONG, kind STRING, payload STRING").withColumn("model_version", F.lit("v1"))
    cases = [
        (1, "category", "mortgage", 1, True), (2, "category", "other", 1, False), (3, "category", "mortgage", None, None), (4, "category", "other", 2, False),
        (5, "category", None, 2, True), (6, "duplicate", "7", 3, True), (7, "duplicate", "8", 3, False), (8, "duplicate", "7", 4, False),
        (9, "priority", "high", 5, None), (10, "duplicate", None, 3, False), (11, "priority", "mortgage", 1, True),
    ]
    events = spark.createDataFrame([c[:4] for c in cases], "id LONG, kind STRING, to_value STRING, prediction_id LONG")
    got = {r.id: r.accepted for r in evidence.verdicts(events, predictions).collect()}
    assert got == {c[0]: c[4] for c in cases}


def test_latest_prediction_breaks_ties_by_id(spark):
    rows = [(1, 5, "triage", at(1)), (2, 5, "triage", at(1)), (3, 5, "risk", at(0)), (4, 5, "triage", at(0))]
    df = spark.createDataFrame(rows, "id LONG, complaint_id LONG, kind STRING, created_at TIMESTAMP_NTZ").withColumns(
        {"payload": F.lit("{}"), "model_name": F.lit("m"), "model_version": F.lit("v")})
    assert sorted(r.id for r in evidence.latest_predictions(df).collect()) == [2, 3]


def test_intake_and_upsert(spark):
    domains = spark.createDataFrame([(1, True), (2, False)], "id LONG, is_active BOOLEAN")
    rows = [(1, 1, " a ", "b"), (2, 2, "a", "b"), (3, 1, "  ", "b"), (4, 1, "a", " "), (5, None, "a", "b"), (6, 1, "x" * 301, "b"), (7, 1, "x" * 300, "b"), (8, 3, "a", "b"), (9, 1, None, "b")]
    requests = spark.createDataFrame(rows, "id LONG, domain_id LONG, title STRING, body STRING").withColumn("submitted_by", F.lit(1))
    got = {r.id: r.reason for r in keyed.validate_intake(requests, domains).collect()}
    assert got == {1: None, 2: "domain_unavailable", 3: "title_required", 4: "body_required", 5: "domain_required", 6: "title_too_long", 7: None, 8: "domain_unavailable", 9: "title_required"}
    target = spark.createDataFrame([(1, "a")], "id LONG, k STRING")
    incoming = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "id LONG, k STRING")
    once = keyed.insert_if_absent(target, incoming, ["k"], "id")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (3, "b")]
    assert keyed.insert_if_absent(once, incoming, ["k"], "id").count() == 2


def test_append_only_and_deletes(spark, tmp_path):
    stored = spark.createDataFrame([(1,), (2,)], "id LONG")
    with pytest.raises(ValueError):
        keyed.append_only(stored, spark.createDataFrame([(2,), (3,)], "id LONG"), str(tmp_path / "p"))
    keyed.append_only(stored, spark.createDataFrame([(3,)], "id LONG"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    rows = spark.createDataFrame([(1, 2), (2, None), (3, 5)], "id LONG, ref LONG")
    assert {r.id: r.ref for r in keyed.set_null_on_delete(rows, "ref", spark.createDataFrame([(2,)], "id LONG")).collect()} == {1: None, 2: None, 3: 5}


def test_resumed_ingest_reads_only_new_files(spark):
    manifest = spark.createDataFrame([("a.csv", "1"), ("b.csv", "2")], "path STRING, checksum STRING")
    listing = spark.createDataFrame([("a.csv", "1"), ("b.csv", "9"), ("c.csv", "3")], "path STRING, checksum STRING")
    assert sorted(r.path for r in keyed.pending_files(manifest, listing).collect()) == ["b.csv", "c.csv"]


def test_packs_read_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text('Complaint ID,Consumer complaint narrative,Product,Date received,Timely response?\n1,"two\nlines",Mortgage,2024-01-02,Yes\n2,,Mortgage,2024-01-02,No\n3,x,Other,2024-01-03,\n')
    got = {r.external_id: (r.text, r.sla_met) for r in packs.read_raw_csv(spark, "cfpb", str(tmp_path / "f.csv")).collect()}
    assert got == {"1": ("two\nlines", True), "3": ("x", None)}
    (tmp_path / "c.csv").write_text("Unique Key,Descriptor,Complaint Type,Created Date,Closed Date\n1,d,Noise,01/02/2024 01:00:00 PM,01/03/2024 01:00:00 PM\n2,d,Noise,01/02/2024 01:00:00 PM,01/03/2024 01:00:01 PM\n3,d,Noise,01/02/2024 01:00:00 PM,\n")
    got = {r.external_id: r.sla_met for r in packs.read_raw_csv(spark, "nyc311", str(tmp_path / "c.csv")).collect()}
    assert got == {"1": True, "2": False, "3": None}
    with pytest.raises(packs.PackNotRegistered):
        packs.pack_for("nowhere")


def test_a_new_pack_brings_its_categories(spark, monkeypatch):
    monkeypatch.setitem(packs.PACKS, "widgets", packs.PackSpec("widgets", "Widgets", (("widget", "Widget", 24),)))
    got = [tuple(r) for r in packs.pack_categories(spark).filter("domain_slug = 'widgets'").collect()]
    assert got == [("widgets", "Widgets", "widget", "Widget", 24)]


def test_null_scores_and_registry(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id LONG, domain_slug STRING")
    row = with_null_scores(df).first()
    assert (row.triage.category_slug, row.triage.confidence, row.triage.model_version) == (None, 0.0, "null")
    assert row.matches == [] and (row.risk.score, row.risk.band, row.risk.model_version) == (0.0, "unknown", "null")
    registry = ScorerRegistry()
    registry.install("a", "risk", "v7", lambda d: null_risk(d).withColumn("risk", F.struct(F.lit(0.5).alias("score"), F.lit("high").alias("band"), F.lit("v7").alias("model_version"))))
    got = {r.id: r.risk.model_version for r in registry.apply(df, "risk").collect()}
    assert got == {1: "v7", 2: "null", 3: "null"} and registry.versions() == {"a": {"risk": "v7"}}
    assert registry.resolve("b", "triage") is null_triage


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_prefix_operators_under_skew(spark, hot):
    rows = [(0 if i % 10 < hot * 10 else i % 7, i, (i * 37) % 11 - 5, i if i % 4 == 0 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k LONG, o LONG, v LONG, w LONG").repartition(7)
    total, last, low, expected = {}, {}, {}, {}
    for k, o, v, w in rows:
        expected[(k, o)] = (last.get(k), low.get(k), total.get(k, 0), total.get(k, 0) + v)
        total[k] = total.get(k, 0) + v
        last[k] = w if w is not None else last.get(k)
        low[k] = v if k not in low else min(low[k], v)
    carried = last_before(df, "k", ["o"], {"last_w": F.col("w")}, {"low_v": F.col("v")})
    assert {(r.k, r.o): (r.last_w, r.low_v) for r in carried.collect()} == {key: e[:2] for key, e in expected.items()}
    for inclusive in (True, False):
        sums = running_totals(df, ["k"], "o", ["v"], inclusive)
        assert {(r.k, r.o): r.v for r in sums.collect()} == {key: e[3 if inclusive else 2] for key, e in expected.items()}
    assert [r.o for r in global_position(df.select("o"), [F.col("o").desc()]).orderBy("pos").collect()] == list(range(1999, -1, -1))


def test_queue_depth_and_history_do_not_see_the_future(spark):
    rows = [(1, 1, 11, "resolved", at(0), at(0), at(5), at(3)), (2, 1, 11, "resolved", at(1), at(1), at(2), at(4)), (3, 1, 11, "in_review", at(3), at(3), at(9), None),
            (4, 1, 11, "in_review", at(4), at(5), at(9), None), (5, 1, 11, "duplicate", at(2), None, None, None), (6, 2, 21, "in_review", at(4), at(4), at(9), None)]
    df = spark.createDataFrame(rows, "id LONG, domain_id LONG, category_id LONG, status STRING, created_at TIMESTAMP_NTZ, triaged_at TIMESTAMP_NTZ, due_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ")
    assert {r.id: r.queue_depth for r in sla.queue_depth(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}
    got = {r.id: (r.n_resolved, r.mean_resolution_hours, r.breach_rate) for r in sla.category_history_asof(df).collect()}
    # Resolutions at the very moment do not count yet.
    assert got == {1: (0, None, None), 2: (0, None, None), 3: (0, None, None), 4: (2, 3.0, 0.5), 6: (0, None, None)}


def test_metrics(spark):
    graded = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", None)], "label STRING, predicted STRING")
    got = {r["class"]: (r.precision, r.recall, r.f1) for r in evaluate.class_metrics(graded).collect()}
    assert got == {"a": (1.0, 0.5, 0.666667), "b": (0.5, 1.0, 0.666667), "c": (0.0, 0.0, 0.0)}
    ranked = spark.createDataFrame([(1, 0.9, True), (2, 0.5, True), (3, 0.5, False), (4, 0.1, False), (5, 0.7, None)], "id LONG, score DOUBLE, label BOOLEAN")
    assert evaluate.roc_auc(ranked).first()[0] == 0.875
    assert evaluate.roc_auc(ranked.filter("label")).first()[0] is None
    assert evaluate.metric_floor({"roc_auc": evaluate.roc_auc(ranked)}, {"roc_auc": 0.9}).first().failed


def test_rows_without_a_key_are_listed_not_lost(spark):
    incoming = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None), (4, "a", 1)], "id LONG, title STRING, submitted_by LONG")
    key = ["title", "submitted_by"]
    written = keyed.insert_if_absent(incoming.filter("false"), incoming, key, "id")
    assert [r.id for r in written.collect()] == [1]
    assert {(r.id, r.missing) for r in keyed.missing_key(incoming, key).collect()} == {(2, "title"), (3, "submitted_by")}


def test_ids_repeated_in_a_batch_conflict(spark, tmp_path):
    stored = spark.createDataFrame([(1,)], "id LONG")
    batch = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id LONG")
    assert sorted(r.id for r in keyed.append_conflicts(stored, batch).collect()) == [1, 2, 2]
    with pytest.raises(ValueError):
        keyed.append_only(stored.filter("false"), batch.filter("id > 1"), str(tmp_path / "p"))


def test_unreadable_dates_and_unmapped_labels(spark):
    columns = ["Unique Key", "Descriptor", "Complaint Type", "Created Date", "Closed Date"]
    rows = [
        ("1", "x", "Noise - Residential", "01/02/2024 03:00:00 AM", "01/02/2024 04:00:00 AM"), ("2", "x", "Noise", "bad date", None),
        ("3", "x", "Noise", "01/02/2024 03:00:00 AM", "13/13/2024"), ("4", "x", "Noise", "01/02/2024 03:00:00 AM", ""),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in columns))
    assert {(r.external_id, r.value) for r in packs.civic_rejects(raw).collect()} == {("2", "bad date"), ("3", "13/13/2024")}
    assert {r.external_id: r.sla_met for r in packs.civic_adapter(raw).collect()} == {"1": None, "4": None}
    mapped = packs.civic_adapter(raw, {"Noise - Residential": "Noise"}).collect()
    assert {r.external_id: r.sla_met for r in mapped} == {"1": True, "4": None}
    assert [tuple(r) for r in packs.unmapped_labels(raw).collect()] == [("Noise - Residential", 1)]
    assert packs.unmapped_labels(raw, {"Noise - Residential": "Noise"}).isEmpty()


def test_commands_are_authorised_before_they_are_tried(spark):
    grants = spark.createDataFrame([(1, p) for p in access.FLAG_PERMISSIONS.values()] + [(1, access.VIEW_QUEUE), (2, access.FLAG_PERMISSIONS["can_assign"])], "user_id LONG, permission STRING")
    rows = [
        (1, 10, "triage", None, None, 1), (2, 10, "triage", None, None, 3), (3, 99, "triage", None, None, 1), (4, 10, "assign", None, "ann", 2),
        (5, 20, "assign", None, "ann", 2), (6, 20, "assign", None, "bob", 2), (7, 10, "transition", "resolved", None, 2), (8, 10, "transition", "closed", None, None),
    ]
    commands = spark.createDataFrame(rows, "seq LONG, complaint_id LONG, op STRING, to_status STRING, assignee STRING, actor_id LONG")
    complaints = spark.createDataFrame([(10, 5), (20, 2)], "complaint_id LONG, submitted_by LONG")
    got = {r.seq: r.denied for r in access.command_access(commands, grants, complaints, spark.createDataFrame([("ann",)], "assignee STRING")).collect()}
    assert got == {1: None, 2: "forbidden", 3: "not_found", 4: "not_found", 5: None, 6: "unknown_assignee", 7: "forbidden", 8: "forbidden"}


def test_texts_are_fetched_for_overridden_complaints_only(spark):
    judged = spark.createDataFrame(
        [(1, "category", "a", "v1", False), (2, "category", "b", "v1", True), (3, "duplicate", "7", "v1", None), (1, "duplicate", "2", "v2", False), (9, "category", "a", "v1", False)],
        "complaint_id long, kind string, to_value string, model_version string, accepted boolean",
    )
    asked = []

    def with_texts(rows):
        asked.extend(r.complaint_id for r in rows.collect())
        return rows.withColumn("title", F.lit("t")).withColumn("body", F.concat(F.lit("text "), "complaint_id"))

    found = evidence.override_corpus(judged, spark.range(1, 6), with_texts).collect()
    assert asked == [1, 1]
    assert sorted(tuple(r) for r in found) == [(1, "category", "a", "v1", "t", "text 1"), (1, "duplicate", "2", "v2", "t", "text 1")]


def test_references_to_a_row_are_made_distinct_before_they_meet_it(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("domain_id"))
    refused = keyed.protected_delete(spark.range(5), rows, "domain_id")
    assert "Aggregate [id" in refused._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in refused.collect()) == [0, 1, 2]


def test_chains_do_not_pass_through_the_driver(spark, monkeypatch):
    """Links of every round are shuffled, however small the table: sent out as a whole they would pass the driver once per round."""
    plans = []

    def spied(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, label)

    monkeypatch.setattr(duplicates, "pin", spied)
    links = [(i, i - 1 if i else None) for i in range(20)] + [(20, 21), (21, 20), (22, 21), (23, 23), (24, 999)]
    got = {r.id: (r.root, r.hops) for r in duplicates.canonical_roots(spark.createDataFrame(links, "id LONG, duplicate_of LONG")).collect()}
    assert got == {**{i: (0, i) for i in range(1, 20)}, 20: (None, None), 21: (None, None), 22: (None, None), 24: (999, 1)}
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans)
