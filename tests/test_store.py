"""Saved models, their metadata and pins."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.models import risk, store, triage


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, f"{'red apple' if i % 2 else 'blue ocean'} filler {i % 7}", "ab"[i % 2], "train" if i < 40 else "calibrate", "asia" if i % 3 else "europe") for i in range(60)]
    return spark.createDataFrame(rows, "id LONG, text STRING, label STRING, split STRING, domain_slug STRING")


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.random(len(S.RISK_FEATURES)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id LONG, " + ", ".join(f"{n} DOUBLE" for n in S.RISK_FEATURES))
    return df.withColumn("breached", F.col("queue_depth") > 0.5)


def test_models_come_back_with_equal_scores(spark, texts, features, tmp_path):
    root = str(tmp_path)
    text_model = triage.fit(texts, word_buckets=1 << 10, char_buckets=1 << 8, max_iter=3)
    trees = risk.fit(features, max_iter=2)
    store.save(text_model, root, "asia", "triage", texts, ["id", "text", "label"], {"macro_f1": 0.9}, "2024-01-01 00:00:00")
    store.save(trees, root, "asia", "risk", features, ["id", "breached"], {"roc_auc": 0.4}, "2024-01-02 00:00:00")
    again, grown = store.load(spark, root, "asia", "triage", text_model.version), store.load(spark, root, "asia", "risk", trees.version)
    one, other = ({r.id: (r.probs, r.triage) for r in m.predict(texts, 0.5).collect()} for m in (text_model, again))
    assert one == other and again.labels == ["a", "b"]
    one, other = ({r.id: r.risk for r in m.predict(features, {"high": 0.5}).collect()} for m in (trees, grown))
    assert one == other
    rows = {r.kind: r for r in store.metadata(spark, root).collect()}
    assert rows["risk"].trained_at == datetime(2024, 1, 2) and rows["risk"].features == list(S.RISK_FEATURES) and rows["triage"].dataset_rows == 60
    with pytest.raises(ValueError, match="already"):
        store.save(trees, root, "asia", "risk", features, ["id"], {}, "2024-01-03 00:00:00")
    with pytest.raises(LookupError):
        store.load(spark, root, "asia", "risk", "risk-9")


def test_rollback_moves_the_pin(spark, features, tmp_path):
    root = str(tmp_path)
    first = risk.fit(features, max_iter=1)
    second = replace(first, version="risk-2")
    for model, auc in ((first, 0.8), (second, 0.5)):
        store.save(model, root, "asia", "risk", features, ["id"], {"roc_auc": auc, "other": 0.1}, "2024-01-01 00:00:00")
    hashes = {r.dataset_hash for r in store.metadata(spark, root).collect()}
    assert len(hashes) == 1  # both from the same rows
    assert store.pinned(spark, root).collect() == [] and store.below_floor(spark, root, {"roc_auc": 0.55}).collect() == []
    for version in ("risk-1", "risk-2", "risk-1"):
        store.move_pin(spark, root, "asia", "risk", version)
        assert [tuple(r) for r in store.pinned(spark, root).collect()] == [("asia", "risk", version)]
        failed = {r.metric: r.failed for r in store.below_floor(spark, root, {"roc_auc": 0.55}).collect()}
        assert failed == {"roc_auc": version == "risk-2"}
    with pytest.raises(LookupError):
        store.move_pin(spark, root, "asia", "risk", "risk-3")
    rows = features.withColumn("domain_slug", F.when(F.col("id") % 2 == 0, "asia").otherwise("europe"))
    scored = store.serving(spark, root, 0.5, {"high": 0.5}).apply(rows, "risk").select("domain_slug", "risk.model_version").distinct().collect()
    assert {tuple(r) for r in scored} == {("asia", "risk-1"), ("europe", "null")}


def test_a_half_written_version_can_be_saved_again(spark, features, tmp_path):
    root, model = str(tmp_path), risk.fit(features, max_iter=1)
    model.trees.write().save(f"{root}/asia/risk/{model.version}/trees")  # no metadata row: the save did not end
    with pytest.raises(LookupError):
        store.load(spark, root, "asia", "risk", model.version)
    store.save(model, root, "asia", "risk", features, ["id"], {}, "2024-01-01 00:00:00")
    assert store.load(spark, root, "asia", "risk", model.version).version == model.version
