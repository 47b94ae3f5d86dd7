"""Scorer interfaces, their null implementations, and resolution per domain.

A scorer is a function from a table to the same table with one more result column, so a fitted
``pyspark.ml`` model, a Pandas function or a literal all fit behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import stable_bucket

Scorer = Callable[[DataFrame], DataFrame]
RESULT_COLUMN = {"triage": "triage", "dedup": "matches", "risk": "risk"}


def null_triage(df: DataFrame) -> DataFrame:
    value = F.struct(F.lit(None).cast("string").alias("category_slug"), F.lit(0.0).alias("confidence"), F.lit(S.NULL_VERSION).alias("model_version"))
    return df.withColumn("triage", value)


def null_dedup(df: DataFrame) -> DataFrame:
    return df.withColumn("matches", F.array().cast(S.MATCH_RESULT))


def null_risk(df: DataFrame) -> DataFrame:
    value = F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("band"), F.lit(S.NULL_VERSION).alias("model_version"))
    return df.withColumn("risk", value)


NULL_SCORERS: dict[str, Scorer] = {"triage": null_triage, "dedup": null_dedup, "risk": null_risk}


def with_null_scores(df: DataFrame) -> DataFrame:
    return null_risk(null_dedup(null_triage(df)))


class ScorerRegistry:
    """Which scorer serves a domain and kind; anything not installed resolves to the null scorer."""

    def __init__(self) -> None:
        self._scorers: dict[tuple[str, str], tuple[str, Scorer]] = {}

    def install(self, domain: str, kind: str, version: str, scorer: Scorer) -> None:
        self._scorers[(domain, kind)] = (version, scorer)

    def resolve(self, domain: str, kind: str) -> Scorer:
        return self._scorers.get((domain, kind), (S.NULL_VERSION, NULL_SCORERS[kind]))[1]

    def versions(self) -> dict[str, dict[str, str]]:
        out: dict[str, dict[str, str]] = {}
        for (domain, kind), (version, _) in self._scorers.items():
            out.setdefault(domain, {})[kind] = version
        return out

    def apply(self, df: DataFrame, kind: str, domain_column: str = "domain_slug") -> DataFrame:
        """Score every row with its own domain's scorer."""
        served = sorted(d for d, k in self._scorers if k == kind)
        domain = F.col(domain_column)
        rest = df.filter(~F.coalesce(domain.isin(served), F.lit(False))) if served else df
        out = NULL_SCORERS[kind](rest)
        for slug in served:
            out = out.unionByName(self.resolve(slug, kind)(df.filter(domain == slug)))
        return out


def split_of(key: Column) -> Column:
    """Stable 6:2:2 assignment to train, calibrate and held_out; depends on the key alone."""
    bucket = stable_bucket(key, 10)
    return F.when(bucket >= 8, "held_out").when(bucket >= 6, "calibrate").otherwise("train")
