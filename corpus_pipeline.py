"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Order: quality rules, near-duplicate removal, benchmark decontamination, secret redaction, packing. Every stage works on all that
its predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import decontaminate, jaccard, packing, quality, secrets
from caseflow.llm.queries import tokenizer_path
from caseflow.session import checkpoint_root, delete_table, recorded, release_unread, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MARK = "[secret]"


#: Tables that the stage before made on its way.
_tables: list[str] = []


def stage(function: Stage) -> Stage:
    """A stage starts when the result of the one before is written, so the tables that one made go then, unless the stage's input reads one of them still."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_unread(spark, docs, _tables)
        with recorded() as made:
            result = function(spark, docs, sf_dir)
        _tables.extend(made)
        return result

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the label model takes for good ones and that fail no basic limit."""
    return quality.keep_good(docs).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of similar documents; documents without an id stay."""
    return jaccard.keep_first(docs).select(*COLUMNS)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter("n_hit = 0").select(*COLUMNS)


@stage
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    found = secrets.find_secrets(docs, keep=COLUMNS)
    hit = F.size("spans") > 0
    text = F.when(hit, secrets.redact("text", "spans", MARK)).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The label model, the tokenizer and the packing are beyond SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents. A stage's tables go once its result is written, and so does the result before it; the last two results stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for number, (_, function) in enumerate(STAGES):
        with scratch(spark):
            path = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}-{number}"
            function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        written.append(path)
        if len(written) > 2:
            delete_table(spark, written.pop(0))
    return docs
