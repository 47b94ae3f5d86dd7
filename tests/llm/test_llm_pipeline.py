"""The pipeline, stage by stage, against a plain version."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from caseflow.llm import jaccard, quality
from test_llm_operators import plain_components, plain_leaks, plain_secrets


def test_stages_agree_with_plain_versions(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    votes = {r.doc_id: r.good for r in quality.judge_quality(docs).withColumn("good", F.col("good") & ~quality.base_failed()).collect()}
    kept = P.quality_rules(spark, docs, smoke_dir)
    assert kept.columns == list(P.COLUMNS)
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, good in votes.items() if good}

    firsts = {i for i, (_, c) in plain_components({i: r.text for i, r in rows.items()}).items() if i == c}
    kept = P.near_duplicates(spark, kept, smoke_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == firsts and len(firsts) < len(rows)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").collect()]
    clean = {i for i, (_, hit, _) in plain_leaks({i: rows[i].text for i in firsts}, items).items() if not hit}
    kept = P.benchmark_decontamination(spark, kept, smoke_dir)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == clean

    kept = P.secret_scan(spark, kept, smoke_dir)
    after = {r.doc_id: r for r in kept.collect()}
    assert set(after) == clean and any(P.MARK in r.text for r in after.values())
    for i, r in after.items():
        text, at, out = rows[i].text, 0, ""
        for _, a, b in plain_secrets(text):
            if a >= at:
                out += text[at:a] + P.MARK
            at = max(at, b)
        assert r.text == out + text[at:] and r.n_chars == len(r.text)

    packed = P.best_fit_packing(spark, kept, smoke_dir).collect()
    assert {r.doc_id for r in packed} == clean


def test_run_over_an_empty_table(spark, smoke_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{smoke_dir}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_copies_add_nothing_to_the_tables_of_near_duplicates(spark, smoke_dir, monkeypatch):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    rows: dict[str, list[int]] = {}
    pinned = jaccard.pin

    def recorded(df, label, *args):
        table = pinned(df, label, *args)
        rows.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(jaccard, "pin", recorded)
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, smoke_dir).select("doc_id").collect()}
    once, rows = rows, {}
    shifted = docs.withColumn("doc_id", F.explode(F.array(*(F.col("doc_id") + 10**6 * i for i in range(6)))))
    assert {r.doc_id for r in P.near_duplicates(spark, shifted, smoke_dir).select("doc_id").collect()} == kept
    # Runs of texts differ, and with them which of a signature's documents stands for it; six copies would be six times as many rows at least.
    assert once["groups"][0] > 0 and rows["groups"][0] < 2 * once["groups"][0] and rows["members"][0] < 2 * once["members"][0]
