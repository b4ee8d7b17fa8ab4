"""Messages delivered at least once, kept exactly once.

A streaming aggregation holds, in Spark's keyed state store, every identifier
seen within the watermark: per (queue, identifier, event-time bucket) the copy
that stays and the number of copies. State expires with the event-time
watermark. Each micro-batch writes what it changed into a folder named by its
batch id (overwritten when a batch is replayed), so output and checkpoint move
together. Aggregation combines on the map side first: an identifier or queue
that holds a third of all rows is one partial row per task before anything is
shuffled.

Rows that the state store can't place (later than the watermark of their batch,
or without an event time) are written by the same micro-batch, pre-aggregated in
the same form. An identifier that comes again after its state expired opens a
new bucket. So the ledger holds, for each message, one entry for every bucket
and every batch with late rows, and reading it merges these few entries: that
is the look-up of late arrivals. The messages that stay and the repeated
identifiers are read from the ledger, not from the input.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import exists, rocksdb_state, work_dir
from millrace.sources.tables import exactly

DELAY, BUCKET = "3 days", "7 days"
_MILLIS_FROM = 100_000_000_000


def event_time(col: Column) -> Column:
    """Unix seconds or milliseconds as a timestamp."""
    return F.timestamp_millis(F.when(F.abs(col) >= _MILLIS_FROM, col).otherwise(col * 1000))


def normal_id(col: Column) -> Column:
    """An identifier in lower case without surrounding white space; blank becomes null."""
    s = F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def _keyed(messages: DataFrame, queue: str, key: str, order: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Identifier, event time and rank of each row: by ``order``, nulls last, ties by a hash of the row."""
    n = F.col(order).cast("long")
    hashed = F.xxhash64(*[F.col(f.name) for f in messages.schema if "map<" not in f.dataType.simpleString()]) if columns else F.lit(0).cast("long")
    return messages.select(
        F.col(queue).alias("queue"),
        normal_id(F.col(key)).alias("key"),
        event_time(F.col(ts).cast("long")).alias("at"),
        F.struct(n.isNull().alias("last"), n.alias("arrival"), hashed.alias("h")).alias("rank"),
        *[F.struct(*columns).alias("row")] * bool(columns),
    ).where("key IS NOT NULL")


def _copies(columns: Sequence[str]) -> list[Column]:
    best = [F.min_by("row", "rank").alias("row")] if columns else []
    return [F.count("*").alias("copies"), F.min("rank").alias("rank"), *best]


def _batch_facts(spark: SparkSession, checkpoint: str, batch_id: int) -> tuple[int, list[str]]:
    """The watermark (ms) by which a micro-batch drops rows, that of the batch before it, and the files it reads."""
    offset = lambda i: [json.loads(r[0]) for r in spark.read.text(f"{checkpoint}/offsets/{i}").collect() if r[0].startswith("{")]
    before = offset(batch_id - 1) if batch_id else None
    late = before[0]["batchWatermarkMs"] if before else 0
    first, last = (before[1]["logOffset"] if before else -1), offset(batch_id)[1]["logOffset"]
    files = set()
    for i in range(first + 1, last + 1):
        log = f"{checkpoint}/sources/0/{i}"
        for r in spark.read.text(log if exists(spark, log) else f"{log}.compact").collect():
            if r[0].startswith("{") and first < (entry := json.loads(r[0]))["batchId"] <= last:
                files.add(entry["path"])
    return late, sorted(files)


def run_stream(
    spark: SparkSession,
    path: str,
    *,
    queue: str = "queue_name",
    key: str = "message_id",
    order: str = "id",
    ts: str = "timestamp",
    columns: Sequence[str] = (),
    delay: str = DELAY,
    bucket: str = BUCKET,
    bytes_per_batch: int = 1 << 30,
    at: str | None = None,
) -> str:
    """Run the stream over everything in ``path`` that no earlier run has read; returns the folder of the ledger.

    ``columns`` are kept of the copy that stays. ``at`` is a folder that keeps checkpoint and ledger between runs, so
    that a later run (with the same arguments) reads new files only; without it a fresh folder is used.
    """
    base = at or work_dir(spark, "messages")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(exactly(path))
    stream = (
        _keyed(source, queue, key, order, ts, columns)
        .where("at IS NOT NULL")
        .withWatermark("at", delay)
        .groupBy("queue", "key", F.window("at", bucket).alias("bucket"))
        .agg(*_copies(columns))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        late, files = _batch_facts(session, f"{base}/checkpoint", batch_id)
        if files:
            rows = _keyed(session.read.schema(schema).parquet(*files), queue, key, order, ts, columns)
            missed = rows.where("at IS NULL")
            if late:
                dropped = rows.withColumn("w", F.window("at", bucket)).where(F.unix_micros("w.end") <= late * 1000)
                missed = missed.unionByName(dropped.drop("w"))
            missed.groupBy("queue", "key").agg(*_copies(columns)).withColumn("bucket", F.lit(None).cast("timestamp")).write.mode("overwrite").parquet(f"{base}/ledger/batch={batch_id}/kind=late")
        batch.withColumn("bucket", F.col("bucket.start")).write.mode("overwrite").parquet(f"{base}/ledger/batch={batch_id}/kind=state")

    with rocksdb_state(spark):
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    return base


def read_ledger(spark: SparkSession, base: str, path: str, *, queue: str = "queue_name", columns: Sequence[str] = ()) -> DataFrame:
    """``(queue, key, copies, rank[, row])``, one row for each message that the stream has written to ``base``.

    An entry of a bucket may have been written by several batches, with rising numbers of copies; late entries count
    once each. All entries of a message meet in one aggregation; there are as many as it has buckets and late batches.
    """
    schema = spark.read.parquet(path).schema
    row = f", row {schema_of(schema, columns)}" if columns else ""
    kind = f"queue {schema[queue].dataType.simpleString()}, key string, bucket timestamp, copies long, rank struct<last:boolean,arrival:long,h:long>{row}, batch int, kind string"
    if not exists(spark, f"{base}/ledger"):  # an empty input writes no batch
        return spark.createDataFrame([], kind).drop("bucket", "batch", "kind")
    entries = spark.read.schema(kind).parquet(f"{base}/ledger").repartition("queue", "key")
    entries = entries.withColumn("late_batch", F.when(F.col("kind") == "late", F.col("batch")))
    best = [F.min_by("row", "rank").alias("row")] if columns else []
    buckets = entries.groupBy("queue", "key", "bucket", "late_batch").agg(F.max("copies").alias("copies"), F.min("rank").alias("rank"), *best)
    return buckets.groupBy("queue", "key").agg(F.sum("copies").alias("copies"), F.min("rank").alias("rank"), *best)


def schema_of(schema, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{schema[c].dataType.simpleString()}" for c in columns) + ">"


def unique_messages(spark: SparkSession, path: str, *, queue: str = "queue_name", key: str = "message_id", order: str = "id", ts: str = "timestamp", **options) -> DataFrame:
    """The rows of ``path`` with exactly one copy of each message; columns as they are.

    The copy that stays is the one with the smallest ``order``; a null ``order`` comes last, and of rows with one order
    one stays, chosen by a hash of the row. Rows with a null or blank identifier are never copies of one another and
    all stay; a null queue is a queue of its own. Other columns may have any name. An empty table gives an empty result.
    """
    messages = spark.read.parquet(path)
    base = run_stream(spark, path, queue=queue, key=key, order=order, ts=ts, columns=messages.columns, **options)
    kept = read_ledger(spark, base, path, queue=queue, columns=messages.columns).select("row.*")
    return kept.unionByName(messages.where(normal_id(F.col(key)).isNull()))


def repeated(spark: SparkSession, path: str, *, queue: str = "queue_name", key: str = "message_id", **options) -> DataFrame:
    """``(queue, key)`` of every message that came more than once, blank identifiers aside; equal rows are copies, too."""
    base = run_stream(spark, path, queue=queue, key=key, **options)
    return read_ledger(spark, base, path, queue=queue).where("copies > 1").select(F.col("queue").alias(queue), F.col("key").alias(key))
