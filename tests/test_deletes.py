"""Deletes over the references of the case entities, and rewrites that leave other files alone."""

from pathlib import Path

import pytest

from caseflow.operators import deletes


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    return {
        "domain": make([(1,), (2,)], "id LONG"), "user": make([(7,), (8,)], "id LONG"),
        "category": make([(10, 1), (11, 1), (20, 2)], "id LONG, domain_id LONG"),
        "complaint": make([(i, 2, 20, 7, 8 if i % 2 else None, i - 1 if i == 105 else None) for i in range(100, 140)], "id LONG, domain_id LONG, category_id LONG, submitted_by LONG, assignee_id LONG, duplicate_of LONG"),
        "event": make([(1000 + i, 100 + i % 40, 2000 + i % 40, 8) for i in range(80)], "id LONG, complaint_id LONG, prediction_id LONG, actor_id LONG"),
        "prediction": make([(2000 + i, 100 + i) for i in range(40)], "id LONG, complaint_id LONG"),
    }


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id LONG")


def test_a_domain_takes_its_categories_and_is_protected_by_complaints(spark, tables):
    plan = deletes.plan_deletes(tables, {"domain": ids(spark, 1)})
    assert {tuple(r) for r in plan.summary().collect()} == {("deleted", "domain", 1), ("deleted", "category", 2)}
    plan = deletes.plan_deletes(tables, {"domain": ids(spark, 2)})
    assert {tuple(r) for r in plan.summary().collect()} == {("deleted", "domain", 1), ("deleted", "category", 1), ("refused", "complaint.domain_id", 40), ("refused", "complaint.category_id", 40)}
    # Together with all that refers to it, it may go.
    plan = deletes.plan_deletes(tables, {"domain": ids(spark, 2), "complaint": tables["complaint"]})
    assert plan.refused.count() == 0 and plan.gone["event"].count() == 80


def test_cascades_and_nulls(spark, tables):
    plan = deletes.plan_deletes(tables, {"complaint": ids(spark, 104), "user": ids(spark, 8)})
    assert {tuple(r) for r in plan.summary().collect()} == {
        ("deleted", "complaint", 1), ("deleted", "user", 1), ("deleted", "event", 2), ("deleted", "prediction", 1),
        ("nulled", "complaint.assignee_id", 20), ("nulled", "complaint.duplicate_of", 1), ("nulled", "event.actor_id", 78),
    }


def test_only_touched_folders_are_written_anew(spark, tables, tmp_path):
    for name, df in tables.items():
        deletes.store(df, str(tmp_path / name), buckets=16)
    files = lambda name: {p for p in Path(tmp_path / name).rglob("part-*")}
    before = {name: files(name) for name in tables}
    with pytest.raises(ValueError, match="referred"):
        deletes.apply(spark, str(tmp_path), deletes.plan_deletes(tables, {"user": ids(spark, 7)}), buckets=16)
    assert {name: files(name) for name in tables} == before  # a refused delete writes nothing
    deletes.apply(spark, str(tmp_path), deletes.plan_deletes(tables, {"complaint": ids(spark, 104)}), buckets=16)
    after = {name: files(name) for name in tables}
    assert all(after[name] == before[name] for name in ("domain", "user", "category"))
    for name, most in (("complaint", 2), ("event", 2), ("prediction", 1)):
        folders = {p.parent for p in before[name] - after[name]}
        assert 1 <= len(folders) <= most and {p for p in before[name] if p.parent not in folders} <= after[name]
    rows = {r.id: r for r in spark.read.parquet(str(tmp_path / "complaint")).collect()}
    assert set(rows) == set(range(100, 140)) - {104} and rows[105].duplicate_of is None and rows[106].assignee_id is None and rows[107].assignee_id == 8
    assert spark.read.parquet(str(tmp_path / "event")).count() == 78 and spark.read.parquet(str(tmp_path / "prediction")).filter("complaint_id = 104").count() == 0
