"""Empirical-Bayes host reputation.

Labelled outcomes of pages are counted per host. Each level borrows from the one above: a suffix shrinks towards the
overall rate, a registered domain towards its suffix, a host towards its domain. The strength of each beta prior comes
from the spread of the rates at that level (method of moments), and a host is judged by a lower posterior bound, so that
hosts with few labels are not blocked by chance.

Only counts per host are shuffled, combined map-side. Null urls and urls without ``://`` form the empty host. Outcomes are
0 (good), 1 (bad) or null (not labelled); repeated pages count once per row. An empty table gives an empty result. Other columns are ignored, and those of
``keep`` that clash with a result are left out. Prior strengths lie between 1 and 1000 labels, so that neither one group nor rates without any spread decide all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import pin

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column, long_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without its port: the suffix is the last label, or one of ``long_suffixes`` (such as ``co.uk``)."""
    host = F.regexp_replace(host, r"\.?(?::[0-9]*)?$", "")
    last = F.substring_index(host, ".", -1)
    two = F.substring_index(host, ".", -2)
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(last)


def _strength(level: DataFrame, mean: str, least: float, most: float) -> float:
    """Prior strength at a level: the labels' worth of prior that explains how far its rates stray from ``mean``.

    Sums over groups of (bad - n m)^2 - n m (1 - m) and of n (n - 1) m (1 - m) estimate the intra-group correlation r;
    the strength of the beta prior is 1 / r - 1.
    """
    m, n, bad = F.col(mean), F.col("n"), F.col("bad")
    extra, scale = level.agg(
        F.sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)), F.sum(n * (n - 1) * m * (1 - m))
    ).first()
    r = extra / scale if scale else 0.0
    return min(most, max(least, 1 / r - 1)) if r > 0 else most


def host_reputation(
    pages: DataFrame, host: str, outcome: str, long_suffixes: tuple[str, ...] = (), z: float = 1.645, least: float = 1.0, most: float = 1000.0
) -> DataFrame:
    """One row per host: n, bad, rate (posterior mean of the bad rate) and low (mean less ``z`` posterior deviations)."""
    domain, suffix = domain_and_suffix(F.col("host"), long_suffixes)
    labelled = F.col(outcome).isNotNull()
    hosts = pin(
        pages.groupBy(F.col(host).alias("host"))
        .agg(F.count(F.when(labelled, 1)).alias("n"), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix}),
        "hosts",
    )
    domains = pin(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((bad or 0) + 0.5) / ((n or 0) + 1.0)

    def shrunk(level: DataFrame, mean: str, out: str) -> DataFrame:
        k = _strength(level, mean, least, most)
        return level.withColumn("strength", F.lit(k)).withColumn(out, (F.col("bad") + k * F.col(mean)) / (F.col("n") + k))

    suffixes = shrunk(suffixes.withColumn("overall", F.lit(overall)), "overall", "suffix_rate").select("suffix", "suffix_rate")
    domains = shrunk(domains.join(suffixes, "suffix"), "suffix_rate", "domain_rate").select("domain", "domain_rate")
    scored = shrunk(hosts.join(domains, "domain"), "domain_rate", "rate")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return scored.select("host", "n", "bad", "rate", (F.col("rate") - z * spread).alias("low"))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and its verdict for a url: (verdict, host/path) fits the host and its subdomains by path prefix; the longest wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, outcome: str, rules: list[tuple[str, str]], keep: tuple[str, ...] = ("page_id",), url: str = "url",
    long_suffixes: tuple[str, ...] = (), most_bad: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict, and the host's n, bad, rate and low.

    A rule decides if one fits; otherwise a host is blocked when the lower bound of its bad rate is over ``most_bad``.
    """
    keep = tuple(c for c in keep if c not in {"host", "path", "rule", "verdict", "n", "bad", "rate", "low"})
    host, path = url_parts(F.col(url))
    rows = pages.select(*keep, F.col(outcome).alias("_outcome"), host.alias("host"), path.alias("path"))
    scores = host_reputation(rows, "host", "_outcome", long_suffixes, z)
    rule, decided = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(decided, F.when(F.col("low") > most_bad, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(scores, "host").select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "n", "bad", "rate", "low")
