"""Domain packs: what a domain is called, its starting taxonomy, and how its raw records are read."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow import schema as S
from caseflow.functions.scalar import hours


class PackNotRegistered(KeyError):
    """No pack is registered for a domain slug."""


@dataclass(frozen=True)
class PackSpec:
    slug: str
    name: str
    categories: tuple[tuple[str, str, int], ...]
    adapter: Callable[[DataFrame], DataFrame] | None = None


def _moment(column: str, form: str) -> Column:
    """A date of an export, null where it is missing or unreadable."""
    return F.try_to_timestamp(F.col(column), F.lit(form)).cast("timestamp_ntz")


def _unreadable(column: str, form: str) -> Column:
    return (F.trim(F.coalesce(F.col(column), F.lit(""))) != "") & _moment(column, form).isNull()


FINANCE_DATE, CIVIC_DATE = "yyyy-MM-dd", "MM/dd/yyyy hh:mm:ss a"


def finance_rejects(raw: DataFrame) -> DataFrame:
    """Rows that the adapter leaves out for their date."""
    return raw.filter(_unreadable("Date received", FINANCE_DATE)).select(
        F.col("Complaint ID").alias("external_id"), F.col("Date received").alias("value"), F.lit("unreadable_date").alias("reason")
    )


def civic_rejects(raw: DataFrame) -> DataFrame:
    """The same, one row per unreadable date."""
    parts = [
        raw.filter(_unreadable(c, CIVIC_DATE)).select(F.col("Unique Key").alias("external_id"), F.col(c).alias("value"), F.lit("unreadable_date").alias("reason"))
        for c in ("Created Date", "Closed Date")
    ]
    return parts[0].unionByName(parts[1])


def finance_adapter(raw: DataFrame) -> DataFrame:
    """Rows with a narrative; those with an unreadable date go to ``finance_rejects``."""
    timely = F.col("`Timely response?`")
    return raw.filter((F.trim("Consumer complaint narrative") != "") & ~_unreadable("Date received", FINANCE_DATE)).select(
        F.col("Complaint ID").alias("external_id"),
        F.col("Consumer complaint narrative").alias("text"),
        F.col("Product").alias("category_label"),
        _moment("Date received", FINANCE_DATE).alias("submitted_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.when(timely == "Yes", True).when(timely == "No", False).alias("sla_met"),
    )


def civic_adapter(raw: DataFrame, categories: Mapping[str, str] | None = None) -> DataFrame:
    """Rows with readable dates; the others go to ``civic_rejects``.

    ``categories`` maps labels of the export, such as "Noise - Residential", to the pack's category names. A label that is
    neither a name nor mapped has no known deadline, and ``sla_met`` stays null: ``unmapped_labels`` lists these.
    """
    names = {name: name for _, name, _ in CIVIC.categories} | dict(categories or {})
    sla = F.element_at(S.literal_map({name: h for _, name, h in CIVIC.categories}), F.element_at(S.literal_map(names), F.col("category_label")))
    return (
        raw.filter(~_unreadable("Created Date", CIVIC_DATE) & ~_unreadable("Closed Date", CIVIC_DATE)).select(
            F.col("Unique Key").alias("external_id"),
            F.col("Descriptor").alias("text"),
            F.col("Complaint Type").alias("category_label"),
            _moment("Created Date", CIVIC_DATE).alias("submitted_at"),
            _moment("Closed Date", CIVIC_DATE).alias("resolved_at"),
        )
        .withColumn("sla_met", F.col("resolved_at") <= F.col("submitted_at") + hours(sla))
    )


def unmapped_labels(raw: DataFrame, categories: Mapping[str, str] | None = None) -> DataFrame:
    known = [name for _, name, _ in CIVIC.categories] + list(categories or {})
    label = F.col("Complaint Type")
    return raw.filter(label.isNotNull() & ~label.isin(known)).groupBy(label.alias("category_label")).agg(F.count("*").alias("n_records"))


# --- fixed values: pack slugs, names and taxonomies with their sla hours ------------------------
FINANCE = PackSpec(
    "cfpb",
    "Consumer Financial",
    (
        ("mortgage", "Mortgage", 72),
        ("credit_card", "Credit card", 48),
        ("debt_collection", "Debt collection", 72),
        ("other", "Other", 96),
    ),
    finance_adapter,
)
CIVIC = PackSpec(
    "nyc311",
    "Civic Services",
    (
        ("noise", "Noise", 24),
        ("street_condition", "Street condition", 120),
        ("sanitation", "Sanitation", 48),
        ("other", "Other", 96),
    ),
    civic_adapter,
)

PACKS: dict[str, PackSpec] = {FINANCE.slug: FINANCE, CIVIC.slug: CIVIC}


def register(pack: PackSpec) -> None:
    PACKS[pack.slug] = pack


def pack_for(slug: str) -> PackSpec:
    if slug not in PACKS:
        raise PackNotRegistered(f"{slug!r} is none of the packs {sorted(PACKS)}")
    return PACKS[slug]


def read_raw_csv(spark: SparkSession, slug: str, path: str, multi_line: bool = True) -> DataFrame:
    """A pack's CSV export as raw complaints. Every source column is text: adapters do the typing.

    Quoted texts with line breaks need ``multi_line``, which makes each file one task: large exports come as many files. An
    export without line breaks in its texts is split freely with ``multi_line=False``.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    adapter = pack_for(slug).adapter
    if adapter is None:
        raise PackNotRegistered(f"pack {slug!r} has no raw adapter")
    return adapter(raw)


def pack_categories(spark: SparkSession) -> DataFrame:
    """The declared taxonomy of all packs, one row per category."""
    entry = "STRUCT<slug: STRING, name: STRING, sla_hours: INT>"
    rows = [(p.slug, p.name, list(p.categories)) for p in PACKS.values()]
    return (
        spark.createDataFrame(rows, f"domain_slug STRING, domain_name STRING, categories ARRAY<{entry}>")
        .select("domain_slug", "domain_name", F.explode("categories").alias("c"))
        .select("domain_slug", "domain_name", F.col("c.slug").alias("category_slug"), F.col("c.name").alias("category_name"), F.col("c.sla_hours").alias("sla_hours"))
    )
