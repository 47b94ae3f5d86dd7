"""Content-addressed WARC archive.

``write_archive`` stores two tables: ``payloads`` with each distinct payload's bytes once, under its SHA-256, and
``records`` with the exact WARC header of every record, its type and the digest it refers to. ``read_archive`` verifies
every stored payload against its digests and joins the records to them; ``rebuild_records`` puts each record's bytes together again and parses them.

The digests decide equality, so only (id, digest) pairs are grouped; payload bytes move once, keyed by record id, which no
hot payload can skew. Null payloads are empty. Of several records with one payload the smallest id is the response, null
ids last; repeated (id, payload) rows are all records of their own, stored once, and all of them responses if the id is the smallest. Null urls
are empty ones. Very long payloads are stored whole; a record is put together in memory. Other columns are ignored, and an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import bounded_batches


def _sha1_base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *front, payload = batch.columns
        raw = [p or b"" for p in payload.to_pylist()]
        digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in raw]
        strong = [hashlib.sha256(p).hexdigest() for p in raw]
        yield pa.RecordBatch.from_arrays(
            [*front, pa.array(map(len, raw), pa.int64()), pa.array(digests, pa.string()), pa.array(strong, pa.string())],
            names=[*batch.schema.names[:-1], "bytes", "sha1", "sha256"],
        )


#: Fixed value: the profile of a revisit record for an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def write_archive(
    pages: DataFrame, path: str, record_id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html",
) -> None:
    """Archive every row of ``pages`` under ``path``; payloads under ``least_bytes`` are never replaced by a reference.

    ``date`` and ``content_type`` are those of all records, as pages have none of their own.
    """
    rows = pages.select(F.col(record_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("body"))
    digests = bounded_batches(rows).mapInArrow(_sha1_base32, "id long, url string, bytes long, sha1 string, sha256 string")
    digests.write.parquet(f"{path}/digests")
    digests = pages.sparkSession.read.parquet(f"{path}/digests")
    firsts = digests.groupBy("sha256").agg(F.min("id").alias("first"))
    known = digests.join(firsts, "sha256")
    revisit = (F.col("bytes") >= least_bytes) & F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    kind = F.when(revisit, "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.coalesce("url", F.lit(""))
    # A header line can't hold line breaks. They are escaped, as is the sign that escapes, and a field says so; all other urls stand as they are.
    broken = uri.rlike(r"[\r\n]")
    escaped = F.replace(F.replace(F.replace(uri, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.when(broken, escaped).otherwise(uri)),
        F.when(broken, line("X-Escaped-Target-URI", F.lit("percent"))).otherwise(""),
        line("Content-Type", F.lit(content_type)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        )).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    records = known.select("id", kind.alias("type"), F.when(revisit, F.col("first")).alias("refers_to"), "sha256", F.col("sha1").alias("stated_sha1"), F.col("bytes").alias("stated_bytes"), header.alias("header"))
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    # Equal ids meet here, so a repeated row's payload is stored once.
    owners = firsts.select(F.col("first").alias("id"), F.col("sha256").alias("key"))
    body = F.coalesce("body", F.lit(b""))
    stored = (
        rows.select("id", body.alias("body"), F.sha2(body, 256).alias("key"))
        .join(owners, ["id", "key"], "left_semi")
        .dropDuplicates(["id", "key"])
    )
    unnamed = rows.filter(F.col("id").isNull()).select("id", body.alias("body"), F.sha2(body, 256).alias("key"))
    nameless = unnamed.join(owners.filter(F.col("id").isNull()).select("key"), "key", "left_semi").dropDuplicates(["key"]).select("id", "body", "key")
    stored.unionByName(nameless).select(F.col("key").alias("sha256"), "body").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: id, type, refers_to, bytes, sha1 and header, with sizes and digests taken from the stored payload.

    A payload that doesn't match its SHA-256 fails the job, and so does a record without its payload or with another SHA-1.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    body = ["body"] if with_payload else []
    checked = stored.select(*body, F.col("sha256").alias("key"), F.col("body").alias("_hashed")).mapInArrow(
        _sha1_base32, f"{'body binary, ' if with_payload else ''}key string, bytes long, sha1 string, sha256 string"
    )
    checked = checked.withColumn("sha256", F.when(F.col("sha256") == F.col("key"), F.col("sha256")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest"))))
    joined = spark.read.parquet(f"{path}/records").join(checked.drop("key"), "sha256", "left")
    sound = (F.col("sha1") == F.col("stated_sha1")) & (F.col("bytes") == F.col("stated_bytes"))
    return joined.select(
        "id", "type", "refers_to", "header", *body, "bytes",
        F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.lit("a record has no payload of its digest"))).alias("sha1"),
    )


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and content of a record's bytes; anything but one whole record is an error."""
    head, mark, rest = raw.partition(END)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if not mark or not version.startswith("WARC/") or len(rest) != length + len(END) or rest[length:] != END:
        raise ValueError("not one whole record")
    return fields, rest[:length]


def url_of(fields: dict[str, str]) -> str:
    """The url that a record was made from."""
    uri = fields["WARC-Target-URI"]
    if "X-Escaped-Target-URI" in fields:
        uri = uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return uri


def rebuild_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, type, refers_to, url, bytes, sha1 and record, the whole record put together from its header and its payload.

    Each record is parsed again. Type and references come from its fields; size and digest of a response come from its content, those of a revisit
    from the payload that it refers to, and have to be the stated ones.
    """
    whole = read_archive(spark, path, with_payload=True).select("id", "header", "body", "bytes", "sha1")
    names = ["id", "type", "refers_to", "url", "bytes", "sha1", "record"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record_id, header, body, size, sha1 in zip(*(batch.column(i) for i in range(5)), strict=True):
                head = header.as_py().encode()
                record = head + (b"" if b"\r\nWARC-Type: revisit\r\n" in head else body.as_py() or b"") + END
                fields, content = parse_record(record)
                response = fields["WARC-Type"] == "response"
                found = (len(content), base64.b32encode(hashlib.sha1(content).digest()).decode()) if response else (size.as_py(), sha1.as_py())
                if fields["WARC-Payload-Digest"] != f"sha1:{found[1]}":
                    raise ValueError("a rebuilt record's payload doesn't match its digest")
                refers = None if response else int(fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                rows.append((record_id.as_py(), fields["WARC-Type"], refers, url_of(fields), *found, record))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return bounded_batches(whole).mapInArrow(build, "id long, type string, refers_to long, url string, bytes long, sha1 string, record binary")
