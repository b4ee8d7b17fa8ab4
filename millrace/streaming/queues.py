"""Queues as event tables: what a consumer would see, computed for all queues at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.streaming.exactly_once import event_time


def pending(messages: DataFrame) -> DataFrame:
    return messages.where(F.lower(F.trim("status")) == "pending")


def peek(messages: DataFrame) -> DataFrame:
    """The oldest pending message of each queue (smallest id): an aggregation, nothing is sorted."""
    return pending(messages).groupBy("queue_name").agg(F.min("id").alias("id"), F.min_by("message_id", "id").alias("message_id"))


def sizes(messages: DataFrame) -> DataFrame:
    """Pending and processing messages of each queue."""
    status = F.lower(F.trim("status"))
    return messages.groupBy("queue_name").agg(F.count_if(status == "pending").alias("pending"), F.count_if(status == "processing").alias("processing"))


def dequeue(messages: DataFrame, n: int) -> DataFrame:
    """The ``n`` oldest pending messages of each queue, taken for processing: ``(queue_name, id, position)``.

    Two aggregations with bounded lists, the first salted, so that a queue with a third of all rows is no single task.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(256))
    first = pending(messages).groupBy("queue_name", salt.alias("s"), F.floor(F.col("id") / 100_000).alias("b")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids"))
    part = first.groupBy("queue_name", "s").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, n).alias("ids"))
    best = part.groupBy("queue_name").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, n).alias("ids"))
    return best.select("queue_name", F.posexplode("ids").alias("at", "id")).select("queue_name", "id", (F.col("at") + 1).alias("position"))


def retained(chunks: DataFrame, stream: str, order: str, n: int = 100) -> DataFrame:
    """``(stream, order)`` of the last ``n`` chunks of each stream: what a new reader is given before what comes next.

    Bounded lists in two steps, the first salted, as one stream may hold a third of all rows.
    """
    newest = lambda c: F.slice(F.sort_array(c, asc=False), 1, n)
    salt, part = F.pmod(F.xxhash64(order), F.lit(256)), F.spark_partition_id()
    first = chunks.where(F.col(order).isNotNull()).groupBy(stream, salt.alias("s"), part.alias("p")).agg(newest(F.collect_list(order)).alias("c"))
    some = first.groupBy(stream, "s").agg(newest(F.flatten(F.collect_list("c"))).alias("c"))
    return some.groupBy(stream).agg(newest(F.flatten(F.collect_list("c"))).alias("c")).select(stream, F.explode("c").alias(order))


def enqueue(messages: DataFrame, path: str) -> None:
    """Append messages to a queue table as pending ones; what reads the table as a stream sees them next."""
    messages.withColumns({"status": F.lit("pending"), "processing_started_at": F.lit(None).cast("long")}).write.mode("append").parquet(path)


def taken(messages: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """At most once: the ``n`` oldest pending messages of each queue, and the table without them."""
    got = dequeue(messages, n)
    return got, messages.join(got.select("id"), "id", "left_anti").select(*messages.columns)


def acknowledge(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages left when those in ``done(id)`` that are processing are deleted."""
    acked = messages.where(F.lower(F.trim("status")) == "processing").select("id").join(done.select("id").distinct(), "id", "left_semi")
    return messages.join(acked, "id", "left_anti")


def recovered_status(status: Column, started: Column, cutoff_s: int) -> Column:
    """Processing messages started at or before ``cutoff_s`` (Unix seconds) become pending again."""
    s = F.lower(F.trim(status))
    return F.when((s == "processing") & (started <= cutoff_s), "pending").otherwise(s)


def arrivals(messages: DataFrame, width: str = "1 day") -> DataFrame:
    """Messages of each queue in tumbling windows of event time."""
    at = event_time(F.col("timestamp").cast("long"))
    w = F.window(at, width)
    return messages.groupBy("queue_name", w.alias("w")).agg(F.count("*").alias("messages")).select("queue_name", F.unix_micros("w.start").alias("start_us"), "messages")
