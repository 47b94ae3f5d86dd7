"""Streams give what the batch jobs give."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.models.base import null_dedup, null_risk, null_triage
from caseflow.operators import keyed, lifecycle
from caseflow.streaming import commands as command_stream
from caseflow.streaming import overdue, scoring
from test_lifecycle import CATEGORIES, interpret, mark, move, random_commands, triage


def test_command_stream_equals_batch(spark, tmp_path):
    rows = sorted(random_commands(11, 240, 24), key=lambda r: (r[1], r[0]))
    categories = spark.createDataFrame(CATEGORIES, S.CATEGORY)
    source = tmp_path / "in"
    for i in range(3):
        spark.createDataFrame(rows[i * 80:(i + 1) * 80], S.COMMAND).coalesce(1).write.mode("append").parquet(str(source))
    stream = command_stream.read_commands(spark, str(source))
    command_stream.start(stream, categories, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    # A complaint without commands so far is not known to a stream yet, so marks at it may be refused
    # for another reason than in the whole batch; accepted changes of the rest are compared.
    state = {r.complaint_id: r for r in command_stream.latest_state(spark, str(tmp_path / "out/state")).collect()}
    assert set(state) == {r[2] for r in rows}
    events = spark.read.parquet(str(tmp_path / "out/events"))
    replayed = {r.complaint_id: r.s for r in events.filter("kind = 'status'").groupBy("complaint_id").agg(F.max_by("to_value", F.struct("seq", "ord")).alias("s")).collect()}
    assert all(state[c].status == replayed.get(c, "submitted") for c in state)

    # A batch that runs twice leaves one set of rows.
    before = events.count()
    batch = spark.createDataFrame(rows[160:], S.COMMAND)
    command_stream.apply_batch(batch, 2, categories, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/events")).count() == before


def test_stream_without_marks_is_identical(spark, tmp_path):
    rows = [r for r in sorted(random_commands(12, 300, 20), key=lambda r: (r[1], r[0])) if r[4] != "mark_duplicate"]
    categories = spark.createDataFrame(CATEGORIES, S.CATEGORY)
    half = len(rows) // 2
    command_stream.apply_batch(spark.createDataFrame(rows[:half], S.COMMAND), 0, categories, str(tmp_path / "first"))
    command_stream.compact(spark, str(tmp_path / "first"), str(tmp_path / "out"))
    command_stream.apply_batch(spark.createDataFrame(rows[half:], S.COMMAND), 0, categories, str(tmp_path / "out"))
    expected, events, refusals = interpret(rows)
    got = {r.complaint_id: (r.status, r.category_slug, r.assignee, r.due_at, r.resolved_at) for r in command_stream.latest_state(spark, str(tmp_path / "out/state")).collect()}
    assert got == {c: (s["status"], s["slug"], s["assignee"], s["due"], s["resolved"]) for c, s in expected.items()}
    for name, expected_rows in (("events", events), ("refusals", refusals)):
        assert sum(spark.read.parquet(str(tmp_path / part / name)).count() for part in ("first", "out")) == len(expected_rows)


def test_overdue_alerts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    h = lambda n: t + timedelta(hours=n)
    batches = [
        [(1, h(0), "triage", h(10)), (2, h(0), "triage", h(10)), (3, h(0), "triage", h(10)), (4, h(0), "triage", h(50))],
        [(2, h(5), "resolved", None), (3, h(6), "triage", h(30))],
        [(9, h(20), "triage", h(90))],
        [(9, h(40), "triage", h(90))],
        [(9, h(41), "triage", h(90))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, overdue.CHANGES).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = spark.readStream.schema(overdue.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = (
        overdue.overdue_alerts(changes).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    alerts = {r.complaint_id: r.due_at for r in spark.read.schema(overdue.ALERTS).parquet(str(tmp_path / "out")).collect()}
    # 2 was resolved in time, 3 moved its deadline, 4 and 9 are not due yet.
    assert alerts == {1: h(10), 3: h(30)}


def test_scoring_survives_a_failing_scorer(spark, tmp_path):
    rows = [(i, f"text {i}", datetime(2024, 1, 1)) for i in range(6)]
    spark.createDataFrame(rows, "id LONG, text STRING, created_at TIMESTAMP_NTZ").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id LONG, text STRING, created_at TIMESTAMP_NTZ").parquet(str(tmp_path / "in"))

    def broken(df):
        raise RuntimeError("no artifact")

    def partly(df):
        return null_triage(df).withColumn("error", F.when(F.col("id") == 3, "too short"))

    scoring.start(stream, {"triage": partly, "dedup": broken}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/complaints")).count() == 6
    predictions = spark.read.parquet(str(tmp_path / "out/predictions"))
    assert sorted(r.complaint_id for r in predictions.collect()) == [0, 1, 2, 4, 5]
    assert predictions.select("payload").distinct().collect()[0][0] == '{"category_slug":null,"confidence":0.0}'
    assert scoring.predictions_of(spark.createDataFrame(rows, "id LONG, text STRING, created_at TIMESTAMP_NTZ"), "dedup", null_dedup, "m").first().payload == '{"matches":[]}'


def test_command_stream_with_marks_is_the_batch(spark, tmp_path):
    """State, events and refusals, over batches that mark complaints which no command has reached yet."""
    rows = sorted(random_commands(21, 260, 18), key=lambda r: (r[1], r[0]))
    categories = spark.createDataFrame(CATEGORIES, S.CATEGORY)
    known = spark.createDataFrame(sorted({(r[2], r[3]) for r in rows}), "complaint_id LONG, domain_id LONG")
    root = str(tmp_path / "out")
    for i in range(4):
        command_stream.apply_batch(spark.createDataFrame(rows[i * 65:(i + 1) * 65], S.COMMAND), i, categories, root, known, buckets=4)
    expected, events, refusals = interpret(rows)
    got = {r.complaint_id: (r.status, r.category_slug, r.assignee, r.duplicate_of, r.due_at, r.resolved_at) for r in command_stream.latest_state(spark, f"{root}/state").collect()}
    assert got == {c: (s["status"], s["slug"], s["assignee"], s["dup"], s["due"], s["resolved"]) for c, s in expected.items()}
    assert sorted((r.seq, r.reason) for r in spark.read.parquet(f"{root}/refusals").collect()) == sorted(refusals)
    told = sorted((r.seq, r.ord, r.kind, r.from_value, r.to_value) for r in spark.read.parquet(f"{root}/events").collect())
    assert told == sorted((e[0], e[1], e[2], e[3], None if e[4] is None else str(e[4])) for e in events)


def test_late_commands_are_refused_and_change_nothing(spark, tmp_path):
    categories, root = spark.createDataFrame(CATEGORIES, S.CATEGORY), str(tmp_path / "out")
    batches = [[triage(1, 1), triage(5, 2)], [move(4, 2, "in_progress"), move(6, 1, "in_progress"), triage(5, 2)], [mark(7, 1, 2)]]
    for i, rows in enumerate(batches):
        command_stream.apply_batch(spark.createDataFrame(rows, S.COMMAND), i, categories, root)
    state = {r.complaint_id: r.status for r in command_stream.latest_state(spark, f"{root}/state").collect()}
    assert state == {1: "duplicate", 2: "in_review"}
    assert sorted((r.seq, r.reason) for r in spark.read.parquet(f"{root}/refusals").collect()) == [(4, "late"), (5, "late")]


def test_a_batch_reads_no_more_after_many_batches(spark, tmp_path):
    categories, root = spark.createDataFrame(CATEGORIES, S.CATEGORY), str(tmp_path / "out")
    sizes = []
    for i in range(8):
        rows = [triage(100 * i + c, c) for c in range(12)]
        command_stream.apply_batch(spark.createDataFrame(rows, S.COMMAND), i, categories, root, buckets=4)
        index = command_stream._index(spark, f"{root}/state")
        assert len(index) <= 4 and set(index.values()) == {i}  # all buckets were touched
        sizes.append(command_stream._rows(spark, f"{root}/state", index).count())
    assert sizes == [12] * 8
    assert len(list(Path(f"{root}/state_index").glob("batch_id=*"))) <= 3
    # A batch run again replaces its own folders and gives the same state.
    before = {r.complaint_id: r for r in command_stream.latest_state(spark, f"{root}/state").collect()}
    command_stream.apply_batch(spark.createDataFrame(rows, S.COMMAND), 7, categories, root, buckets=4)
    assert {r.complaint_id: r for r in command_stream.latest_state(spark, f"{root}/state").collect()} == before
    assert spark.read.parquet(f"{root}/refusals").count() == 0


def test_predictions_are_append_only_and_keep_their_ids(spark, tmp_path):
    rows = [(i, f"text {i}", datetime(2024, 1, 1)) for i in range(5)]
    batch = spark.createDataFrame(rows, "id LONG, text STRING, created_at TIMESTAMP_NTZ")
    root = str(tmp_path / "out")
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{root}/predictions").collect())
    for batch_id in (0, 1):
        scoring.score_batch(batch, batch_id, {"triage": null_triage, "dedup": null_dedup}, root)
    first = read()
    assert len(first) == 20 and len({r[0] for r in first}) == 20
    scoring.score_batch(batch.orderBy(F.col("id").desc()), 1, {"triage": null_triage, "dedup": null_dedup}, root)  # run again: nothing changes
    assert read() == first
    stored = spark.read.parquet(f"{root}/predictions")
    with pytest.raises(ValueError, match="append-only"):
        keyed.append_only(stored, stored.limit(1), f"{root}/predictions/kind_of=triage/batch_id=9")
    # An attempt that failed half-way leaves no mark, and its rows go.
    (tmp_path / "out/predictions/kind_of=triage/batch_id=1/_SUCCESS").unlink()
    scoring.score_batch(batch, 1, {"triage": null_triage}, root)
    assert read() == first


def test_risk_is_scored_when_a_triage_arrives(spark, tmp_path):
    t = datetime(2024, 1, 1)
    submitted = "id LONG, text STRING, created_at TIMESTAMP_NTZ"
    event = "complaint_id LONG, kind STRING, created_at TIMESTAMP_NTZ"
    spark.createDataFrame([(i, "x", t) for i in range(4)], submitted).coalesce(1).write.parquet(str(tmp_path / "subs"))
    events = [(0, "category", t + timedelta(hours=1)), (0, "priority", t + timedelta(hours=1)), (2, "category", t + timedelta(hours=2)), (2, "category", t + timedelta(hours=9)), (3, "category", t - timedelta(hours=1)), (8, "category", t)]
    spark.createDataFrame(events, event).coalesce(1).write.parquet(str(tmp_path / "events"))

    def run():
        scoring.start_risk(
            spark.readStream.schema(submitted).parquet(str(tmp_path / "subs")), spark.readStream.schema(event).parquet(str(tmp_path / "events")), null_risk,
            str(tmp_path / "out"), str(tmp_path / "cp"),
        ).awaitTermination()
        return sorted((r.complaint_id, r.created_at, r.kind, r.payload) for r in spark.read.parquet(str(tmp_path / "out/predictions")).collect())

    payload = '{"band":"unknown","score":0.0}'
    want = [(0, t + timedelta(hours=1), "risk", payload), (2, t + timedelta(hours=2), "risk", payload), (2, t + timedelta(hours=9), "risk", payload)]
    assert run() == want
    spark.createDataFrame([(1, "category", t + timedelta(hours=10))], event).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    assert run() == sorted([*want, (1, t + timedelta(hours=10), "risk", payload)])
    assert spark.read.parquet(str(tmp_path / "out/predictions")).select("id").distinct().count() == 4
