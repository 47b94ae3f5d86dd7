"""The registered queries of this subpackage: thin wrappers that derive the agreed columns from the operators' results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import archive, decontaminate, jaccard, online_packing, packing, quality, repeats, reputation, runs, secrets, shards, spelling, surrogates
from caseflow.session import checkpoint_root
from caseflow.sources.tables import Tables

#: Fixed url rules: (verdict, host/path).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Public suffixes of two labels under which domains are registered; a parameter of the operator.
LONG_SUFFIXES = (
    "ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
    "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.nz", "org.uk",
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(Tables(spark, sf_dir).documents)
    failed = quality.base_failed()
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "posterior",
    )


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a parameter of the operator; a fixed one makes the query repeatable."""
    replaced = surrogates.replace_entities(Tables(spark, sf_dir).documents, key="caseflow")
    kinds = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["end"].cast("string"))), ",")
    return replaced.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("entities"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(Tables(spark, sf_dir).documents)
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"),
    )


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url; a page's labelled outcome is the quality label of the document of the same id (0: bad)."""
    t = Tables(spark, sf_dir)
    labels = t.labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    pages = t.pages.select("page_id", "url").join(labels, "page_id", "left").withColumn("outcome", 1 - F.col("quality"))
    judged = reputation.judge_urls(pages, "outcome", URL_RULES, long_suffixes=LONG_SUFFIXES)
    return judged.withColumns({c: F.round(c, 6) for c in ("rate", "low")})


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    found = decontaminate.find_leaks(t.documents, t.benchmark)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(Tables(spark, sf_dir).documents)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(Tables(spark, sf_dir).documents).drop("spans")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file that a packing query is agreed on; it is read in place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Tables(spark, sf_dir).documents, tokenizer_path())


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    archive.write_archive(Tables(spark, sf_dir).pages, path)
    back = archive.rebuild_records(spark, path)
    return back.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to",
    )


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    text = F.col("text")
    placed = shards.hilbert_shards(
        docs,
        [F.col("n_chars").cast("long"), F.col("lang"), F.col("source")],
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16,
        {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")), "text_hash": F.xxhash64("text")},
        ["text_hash", "doc_id"],
        shards=40,
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def variant_of_run() -> Column:
    """The agreed word of a run: one in 199 loses a letter. Runs of documents without an id lose none."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return F.when(h % 199 == 0, shorter).otherwise(F.col("run"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(Tables(spark, sf_dir).documents.select("doc_id", "text"), variant_of_run()))


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_online(Tables(spark, sf_dir).documents, tokenizer_path("byte_bpe_50k.json"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The agreed documents: in one of ten, words from a place on repeat the first few of them. Documents without an id stay as they are."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(h: Column, w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        copies = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a.cast("int")), copies), F.lit(1), n.cast("int")), " ")

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # The array of one struct binds its fields, so that they are computed once.
    planted = F.transform(F.array(F.struct(h.alias("h"), words.alias("w"))), lambda x: F.when(F.size(x["w"]) > 0, repeated(x["h"], x["w"])).otherwise(""))[0]
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_planted_runs(Tables(spark, sf_dir).documents))
    # length / period is compared exactly; runs come by start, then period, and the first of equal ones stays.
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs), 1)), runs[0], (best, r) -> IF(r.length * best.period > best.length * r.period, r, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.select("doc_id", "runs", F.when(F.size("runs") > 0, best).alias("best"), listed.alias("listed"), "collapsed")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules, op2_pii_surrogates, op3_secret_scan, op4_host_reputation, op5_decontaminate,
        op6_jaccard_join, op7_suffix_dedup, op8_best_fit_packing, op9_warc_archive, op10_hilbert_shards,
        op11_spelling_variants, op12_online_packing, op13_periodic_runs,
    )
}
