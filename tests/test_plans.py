"""The registered queries' plans and contracts."""

import duckdb
import pytest

import __spark_entry__ as entry
from caseflow.plans import relational
from caseflow.sources import entities as E
from caseflow.sources.tables import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_check_belongs_to_a_query():
    queries, checks = entry.queries(), entry.oracle_sql()
    assert set(checks) <= set(queries) and len(checks) >= 75


def test_entry(spark):
    df = entry.entry(spark)
    assert "pos" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", [
    "complaint_view", "my_complaints", "queue_display", "legal_actions", "viewer_actions", "authorised_state", "visible_counts", "acceptance_rate", "latest_prediction", "history_replay_diff",
    "integrity_report", "protected_delete", "queue_depth", "category_history_asof", "risk_queue", "permission_matrix", "lifecycle_state", "roc_auc",
])
def test_no_cross_joins_and_no_python(spark, smoke_dir, name):
    plan = plan_of(relational.REGISTRY[name](spark, smoke_dir))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan, operator


def test_only_needed_columns_and_joins(spark, smoke_dir):
    t = Tables(spark, smoke_dir)
    plan = plan_of(E.complaints(t, ["id", "priority"]))
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in plan
    plan = plan_of(E.complaints(t, ["id", "domain_id"]))
    assert "lineitem" not in plan and "documents" not in plan


def test_untimely_shipping_comes_with_the_one_scan_of_the_lines(spark, smoke_dir):
    rows = E.complaints(Tables(spark, smoke_dir), ["id", "resolved_at", "untimely"])
    assert plan_of(rows).count("l_shipdate#") and plan_of(rows).count("lineitem.parquet") == 1
    want = duckdb.sql(f"""
        SELECT o_orderkey, date_diff('day', o_orderdate, max(l_shipdate)) > 90
        FROM '{smoke_dir}/orders.parquet' LEFT JOIN '{smoke_dir}/lineitem.parquet' ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
    """).fetchall()
    assert {r.id: r.untimely for r in rows.collect()} == dict(want) and {x for _, x in want} >= {True, False}


@pytest.mark.parametrize("name", ["agent_queue", "lifecycle_duplicates", "acceptance_rate", "dedup_topk", "canonical_root"])
def test_against_sql(spark, smoke_dir, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{smoke_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, smoke_dir)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))
