"""Versioned model folders with their metadata, and pins that tell which version serves.

``root/<domain>/<kind>/<version>/`` holds a model's parts as Spark ML saves them. ``root/metadata`` is an append-only table with one row per version: when and from what
it was trained, which features it takes, and its measured metrics. A version counts only once its row is there, which is written last, so a save that fails half-way leaves nothing that can
be loaded. ``root/pins`` is append-only too: the newest row of a (domain, kind) names the version that serves, so a rollback is one more row and moves atomically.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.models.base import RESULT_COLUMN, ScorerRegistry
from caseflow.models.risk import RiskModel
from caseflow.models.triage import TriageModel
from caseflow.operators.keyed import dataset_hash
from caseflow.session import delete_table

METADATA = (
    "domain STRING, kind STRING, version STRING, trained_at TIMESTAMP_NTZ, dataset_rows LONG, dataset_hash STRING, features ARRAY<STRING>, settings STRING,"
    " metrics MAP<STRING, DOUBLE>"
)
PINS = "domain STRING, kind STRING, version STRING, place LONG"


def _table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{path}/part=0")
    return spark.read.schema(ddl).parquet(f"{path}/*")


def metadata(spark: SparkSession, root: str) -> DataFrame:
    return _table(spark, f"{root}/metadata", METADATA)


def _parts(model: TriageModel | RiskModel) -> dict[str, object]:
    if isinstance(model, RiskModel):
        return {"trees": model.trees}
    return {"features": model.features, "classifier": model.classifier} | {f"calibrator_{i}": c for i, c in enumerate(model.calibrators)}


def save(
    model: TriageModel | RiskModel, root: str, domain: str, kind: str, trained_on: DataFrame, columns: list[str], metrics: dict[str, float], trained_at: str,
) -> None:
    """Save ``model`` under its own version, with the content hash of ``columns`` of the rows that it was trained on. A version is never written twice."""
    spark = trained_on.sparkSession
    path = f"{root}/{domain}/{kind}/{model.version}"
    known = metadata(spark, root).filter((F.col("domain") == domain) & (F.col("kind") == kind) & (F.col("version") == model.version))
    if known.limit(1).count():
        raise ValueError(f"{domain}/{kind}/{model.version} is there already")
    delete_table(spark, path)  # what an attempt that failed half-way may have left
    for name, part in _parts(model).items():
        part.write().save(f"{path}/{name}")
    triage = isinstance(model, TriageModel)
    settings = {"labels": model.labels, "word_buckets": model.word_buckets, "char_buckets": model.char_buckets} if triage else {}
    content = dataset_hash(trained_on, columns).first()
    row = (domain, kind, model.version, content.n_rows, f"{content.xor_hash}:{content.sum_hash}", ["text"] if triage else list(S.RISK_FEATURES), json.dumps(settings), metrics)
    names = [c.split()[0] for c in METADATA.split(", ") if c.split()[0] != "DOUBLE>"]
    table = spark.createDataFrame([row], "domain STRING, kind STRING, version STRING, dataset_rows LONG, dataset_hash STRING, features ARRAY<STRING>, settings STRING, metrics MAP<STRING, DOUBLE>")
    table.withColumn("trained_at", F.lit(trained_at).cast("timestamp_ntz")).select(*names).write.parquet(f"{root}/metadata/part={domain}-{kind}-{model.version}")


def load(spark: SparkSession, root: str, domain: str, kind: str, version: str) -> TriageModel | RiskModel:
    rows = metadata(spark, root).filter((F.col("domain") == domain) & (F.col("kind") == kind) & (F.col("version") == version)).collect()  # one at most
    if not rows:
        raise LookupError(f"no model {domain}/{kind}/{version}")
    path, settings = f"{root}/{domain}/{kind}/{version}", json.loads(rows[0].settings)
    if kind == "risk":
        return RiskModel(PipelineModel.load(f"{path}/trees"), version)
    calibrators = [IsotonicRegressionModel.load(f"{path}/calibrator_{i}") for i in range(len(settings["labels"]))]
    return TriageModel(
        PipelineModel.load(f"{path}/features"), LogisticRegressionModel.load(f"{path}/classifier"), calibrators, settings["labels"], settings["word_buckets"],
        settings["char_buckets"], version,
    )


def move_pin(spark: SparkSession, root: str, domain: str, kind: str, version: str) -> None:
    """From now on ``version``, an older one too, serves ``domain`` and ``kind``; it has to be there."""
    load(spark, root, domain, kind, version)
    pins = _table(spark, f"{root}/pins", PINS)
    place = 1 + (pins.agg(F.max("place")).first()[0] or 0)
    spark.createDataFrame([(domain, kind, version, place)], PINS).write.parquet(f"{root}/pins/part={place}")  # two movers at once: one of them fails


def pinned(spark: SparkSession, root: str) -> DataFrame:
    """(domain, kind, version) that serve now."""
    return _table(spark, f"{root}/pins", PINS).groupBy("domain", "kind").agg(F.max_by("version", "place").alias("version"))


def serving(spark: SparkSession, root: str, threshold: float, bands: dict[str, float]) -> ScorerRegistry:
    """A registry of the pinned models; everything else resolves to the null scorers."""
    registry = ScorerRegistry()
    for row in pinned(spark, root).collect():  # one per domain and kind
        model = load(spark, root, row.domain, row.kind, row.version)
        limit, result = bands if row.kind == "risk" else threshold, RESULT_COLUMN[row.kind]
        # A scorer adds its result and nothing else, so that rows of several scorers fit together.
        scorer = lambda df, model=model, limit=limit, result=result: model.predict(df, limit).select(*df.columns, result)
        registry.install(row.domain, row.kind, row.version, scorer)
    return registry


def below_floor(spark: SparkSession, root: str, floors: dict[str, float]) -> DataFrame:
    """(domain, kind, version, metric, value, floor, failed) of the pinned versions' stored metrics that have a floor."""
    limits = spark.createDataFrame(list(floors.items()), "metric STRING, floor DOUBLE")
    stated = metadata(spark, root).join(pinned(spark, root), ["domain", "kind", "version"]).select("domain", "kind", "version", F.explode("metrics").alias("metric", "value"))
    return stated.join(limits, "metric").select("domain", "kind", "version", "metric", "value", "floor", (F.col("value") < F.col("floor")).alias("failed"))
