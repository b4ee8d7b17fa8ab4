"""Stateful operators on event streams: heartbeats and rotation. Each runs as a stream over files until all is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import exists, rocksdb_state, work_dir
from millrace.sources.tables import exactly


def heartbeat_sessions(spark: SparkSession, path: str, *, key: str = "user_id", at: str = "ts", timeout: str = "5 minutes", delay: str = "40 days") -> DataFrame:
    """``(key, start_us, end_us, beats)``: spans in which a key was kept alive, each beat renewing it for ``timeout``.

    A session window in the state store; a session leaves it, and is written once, when the watermark passes its end.
    Sessions still open when the input ends come out by two closing beats, far behind the last one, that the stream reads
    from a folder of its own. Beats without a time are left out, and in an input of several batches those that come more than ``delay`` behind; a null key is a key, an empty input gives an empty result.
    """
    base = work_dir(spark, "heartbeats")
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType.simpleString()
    out = f"key {kind}, start_us long, end_us long, beats long"
    last = table.agg(F.max(F.col(at).cast("timestamp"))).first()[0]
    if last is None:
        return spark.createDataFrame([], out)
    closing = f"key {kind}, at timestamp"
    spark.createDataFrame([], closing).write.parquet(f"{base}/closing")
    beats = spark.readStream.schema(table.schema).parquet(exactly(path)).select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at"), F.lit(False).alias("closing"))
    ends = spark.readStream.schema(closing).parquet(f"{base}/closing").withColumn("closing", F.lit(True))
    every = beats.union(ends).where("at IS NOT NULL").withWatermark("at", delay)
    spans = every.groupBy("key", "closing", F.session_window("at", timeout).alias("w")).agg(F.count("*").alias("beats"))

    def write(batch: DataFrame, batch_id: int) -> None:  # a filter in the stream would keep closing beats from its watermark
        batch.where("NOT closing").drop("closing").write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    with rocksdb_state(spark):
        for turn in range(3):
            if turn:  # the first closing beat moves the watermark, the batch of the second one lets go what it has passed
                late = F.lit(last) + F.expr(f"({turn} + 1) * (INTERVAL '{delay}' + INTERVAL '{timeout}')")
                spark.range(1).select(F.lit(None).cast(kind).alias("key"), late.alias("at")).write.mode("append").parquet(f"{base}/closing")
            query = (
                spans.select("key", "closing", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "beats")
                .writeStream.outputMode("append")
                .option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True)
                .foreachBatch(write)
                .start()
            )
            query.awaitTermination()
    return spark.read.schema(out).parquet(f"{base}/out").select("key", "start_us", "end_us", "beats")


def alive_at(last: DataFrame, now_us: int, timeout_s: int = 300) -> DataFrame:
    """``(key, last_us, expire_us, status)``: a key is expired once ``now`` is past its last beat plus the timeout."""
    expire = F.col("last_us") + timeout_s * 1_000_000
    return last.select("key", "last_us", expire.alias("expire_us"), F.when(F.lit(now_us) > expire, "expired").otherwise("alive").alias("status"))


def rotate(rows: DataFrame, limit: int) -> DataFrame:
    """``(channel, seq, part)``: rows of each channel in order of ``seq`` go to part files; a row that would push the
    current part past ``limit`` opens the next one. ``rows(channel, seq, size)``.

    The rule is sequential within a channel, so a channel is folded in one task, as a stream of Arrow batches sorted
    by ``seq``: only the running size is kept in memory.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, part, used = object(), 0, 0
        for f in frames:
            parts = []
            for c, n in zip(f["channel"].to_numpy(), f["size"].to_numpy()):
                if c != channel:
                    channel, part, used = c, 0, 0
                if used and used + n > limit:
                    part, used = part + 1, 0
                used += int(n)
                parts.append(part)
            yield pd.DataFrame({"channel": f["channel"], "seq": f["seq"], "part": parts})

    kind = rows.schema["channel"].dataType.simpleString()
    ordered = rows.select("channel", F.col("seq").cast("long").alias("seq"), F.coalesce("size", F.lit(0)).cast("long").alias("size")).where("channel IS NOT NULL")
    return ordered.repartition("channel").sortWithinPartitions("channel", "seq").mapInPandas(fold, f"channel {kind}, seq long, part int")
