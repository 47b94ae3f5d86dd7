"""Commands arriving as a stream: state, events and refusals are kept up batch by batch.

State is a table in buckets of complaints. A batch reads the buckets that it touches or points at, and writes those that it changes anew, whole, under its own
number; a small index says for each bucket which batch wrote it last. So what a batch reads depends on the buckets it touches and not on
how many batches came before. Each output is a folder of its batch and replaces it, and state is read as of the batch before, so a batch
that is run again after a failure gives the same rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseflow import schema as S
from caseflow.operators import lifecycle
from caseflow.session import delete_table, pin, scratch

STATE = (
    "complaint_id LONG, domain_id LONG, status STRING, category_id LONG, category_slug STRING, priority STRING, assignee STRING,"
    " duplicate_of LONG, triaged_at TIMESTAMP_NTZ, due_at TIMESTAMP_NTZ, resolved_at TIMESTAMP_NTZ, last_ts TIMESTAMP_NTZ, last_seq LONG"
)
INDEX = "bucket INT, at LONG, batch_id LONG"
BUCKETS = 64


def bucket_of(complaint_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(complaint_id), F.lit(buckets)).cast("int")


def _index(spark: SparkSession, state_path: str, before_batch: int | None = None) -> dict[int, int]:
    """Bucket -> batch that wrote it last; as many entries as buckets."""
    rows = spark.read.schema(INDEX).parquet(f"{state_path}_index")
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") < before_batch)
    newest = rows.agg(F.max("batch_id")).first()[0]
    return {r.bucket: r.at for r in rows.filter(F.col("batch_id") == newest).collect()} if newest is not None else {}


def _rows(spark: SparkSession, state_path: str, index: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
    paths = [f"{state_path}/batch_id={at}/bucket={b}" for b, at in sorted(index.items()) if buckets is None or b in buckets]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def latest_state(spark: SparkSession, state_path: str, before_batch: int | None = None) -> DataFrame:
    """Each complaint's newest state row, optionally as it stood before a batch."""
    return _rows(spark, state_path, _index(spark, state_path, before_batch)).drop("last_ts", "last_seq")


def _write_state(rows: DataFrame, index: dict[int, int], state_path: str, batch_id: int, buckets: int) -> None:
    """Write whole buckets under ``batch_id``, and the index with them in it."""
    spark = rows.sparkSession
    placed = pin(rows.withColumn("bucket", bucket_of(F.col("complaint_id"), buckets)), "state")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch_id={batch_id}")
    written = {r.bucket: batch_id for r in placed.select("bucket").distinct().collect()}
    entries = sorted((index | written).items())
    spark.createDataFrame(entries, "bucket INT, at LONG").coalesce(1).write.mode("overwrite").parquet(f"{state_path}_index/batch_id={batch_id}")


def apply_batch(batch: DataFrame, batch_id: int, categories: DataFrame, root: str, known: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Fold one batch on top of the state before it.

    ``known`` (complaint_id, domain_id) lists complaints that exist although no command has reached them yet; marks may point at them. A command that is not later than
    the last one of its complaint in an earlier batch changes nothing and is refused as ``late``. Tables made on the way are gone when it returns.
    """
    with scratch(batch.sparkSession):
        _apply_batch(batch, batch_id, categories, root, known, buckets)


def _apply_batch(batch: DataFrame, batch_id: int, categories: DataFrame, root: str, known: DataFrame | None, buckets: int) -> None:
    spark = batch.sparkSession
    state_path = f"{root}/state"
    # Without any earlier state an empty first index gives the reader a table to look at.
    spark.createDataFrame([], "bucket INT, at LONG").write.mode("ignore").parquet(f"{state_path}_index/batch_id=-2")
    index = _index(spark, state_path, batch_id)
    batch = pin(batch, "batch")
    ids = batch.select("complaint_id").unionByName(batch.filter(F.col("canonical_id").isNotNull()).select(F.col("canonical_id").alias("complaint_id"))).distinct()
    touched = pin(ids.withColumn("bucket", bucket_of(F.col("complaint_id"), buckets)), "touched")
    numbers = {r.bucket for r in touched.select("bucket").distinct().collect()}  # no more than there are buckets
    before = pin(_rows(spark, state_path, index, numbers), "before")
    snapshot = before.join(touched, "complaint_id", "left_semi")

    moments = snapshot.select("complaint_id", "last_ts", "last_seq")
    dated = batch.join(moments, "complaint_id", "left")
    in_time = F.col("last_ts").isNull() | (F.struct("ts", "seq") > F.struct("last_ts", "last_seq"))
    fresh = pin(dated.filter(in_time).drop("last_ts", "last_seq"), "fresh")
    late = dated.filter(~in_time)

    there = [df.select("complaint_id", "domain_id") for df in (fresh, snapshot, *([] if known is None else [known.join(touched, "complaint_id", "left_semi")]))]
    existing = there[0]
    for rows in there[1:]:
        existing = existing.unionByName(rows)
    existing = existing.groupBy("complaint_id").agg(F.min("domain_id").alias("domain_id"))
    folded = lifecycle.run(fresh, categories, existing, snapshot.drop("last_ts", "last_seq"))
    last = fresh.groupBy("complaint_id").agg(F.max(F.struct("ts", "seq")).alias("last"))
    changed = pin(folded.state().join(last, "complaint_id").select("*", F.col("last.ts").alias("last_ts"), F.col("last.seq").alias("last_seq")).drop("last"), "changed")
    rewritten = {r.bucket for r in changed.select(bucket_of(F.col("complaint_id"), buckets).alias("bucket")).distinct().collect()}
    same = before.filter(bucket_of(F.col("complaint_id"), buckets).isin(*rewritten)) if rewritten else before.limit(0)
    names = [c.split()[0] for c in STATE.split(", ")]
    state = changed.select(*names).unionByName(same.join(changed, "complaint_id", "left_anti").select(*names))
    refusals = folded.refusals().unionByName(late.select("complaint_id", "seq", "ts", "op", F.lit(None).cast("string").alias("status_before"), F.lit("late").alias("reason")))
    for name, df in (("events", folded.events()), ("refusals", refusals)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    _write_state(state, index, state_path, batch_id, buckets)
    delete_table(spark, f"{state_path}_index/batch_id={batch_id - 2}")  # a batch run again needs the index before its own, and no older one


def compact(spark: SparkSession, root: str, target: str, buckets: int = BUCKETS) -> None:
    """Write the newest state as the starting state of a new folder, without the buckets that later batches replaced.

    A stream started on ``target``, with a checkpoint of its own, goes on from there.
    """
    state_path = f"{root}/state"
    _write_state(_rows(spark, state_path, _index(spark, state_path)), {}, f"{target}/state", -1, buckets)


def start(commands: DataFrame, categories: DataFrame, root: str, checkpoint: str, known: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Run the lifecycle over a command stream; a complaint's commands must reach it in (ts, seq) order across batches, later ones are refused."""
    return (
        commands.writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, categories, root, known))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_commands(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(S.COMMAND).option("maxFilesPerTrigger", files_per_batch).parquet(path)
