"""Queries for queues, heartbeats and rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import Registry
from millrace.sources.tables import table
from millrace.streaming import events as E
from millrace.streaming import queues as Q

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL


@query("SELECT queue_name, min(id) AS id, arg_min(message_id, id) AS message_id FROM queue_messages WHERE lower(trim(status)) = 'pending' GROUP BY 1")
def queue_peek(spark: SparkSession, d: str) -> DataFrame:
    return Q.peek(table(spark, d, "queue_messages"))


@query("SELECT queue_name, count(*) FILTER (lower(trim(status)) = 'pending') AS pending, count(*) FILTER (lower(trim(status)) = 'processing') AS processing FROM queue_messages GROUP BY 1")
def queue_sizes(spark: SparkSession, d: str) -> DataFrame:
    return Q.sizes(table(spark, d, "queue_messages"))


@query("SELECT queue_name, id, row_number() OVER (PARTITION BY queue_name ORDER BY id) AS position FROM queue_messages WHERE lower(trim(status)) = 'pending' QUALIFY position <= 10")
def queue_dequeue(spark: SparkSession, d: str) -> DataFrame:
    return Q.dequeue(table(spark, d, "queue_messages"), 10)


@query("SELECT id, queue_name FROM queue_messages WHERE NOT (lower(trim(status)) = 'processing' AND processing_started_at % 2 = 0 AND processing_started_at IS NOT NULL)")
def queue_acknowledge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "queue_messages")
    return Q.acknowledge(m, m.where("processing_started_at % 2 = 0").select("id")).select("id", "queue_name")


@query("SELECT id, CASE WHEN lower(trim(status)) = 'processing' AND processing_started_at <= 1742000000 THEN 'pending' ELSE lower(trim(status)) END AS status FROM queue_messages")
def queue_recover(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queue_messages").select("id", Q.recovered_status(F.col("status"), F.col("processing_started_at"), 1742000000).alias("status"))


@query("""SELECT queue_name, epoch_us(make_timestamp(s // 86400 * 86400 * 1000000)) AS start_us, count(*) AS messages FROM (SELECT queue_name, CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp // 1000 ELSE timestamp END AS s FROM queue_messages) GROUP BY ALL""")
def queue_arrivals(spark: SparkSession, d: str) -> DataFrame:
    return Q.arrivals(table(spark, d, "queue_messages"))


@query("""WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), f AS (SELECT *, CASE WHEN t - lag(t) OVER w < 300000000 THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY key ORDER BY t)),
  g AS (SELECT *, sum(b) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT key, min(t) AS start_us, max(t) + 300000000 AS end_us, count(*) AS beats FROM g GROUP BY key, g""")
def heartbeat_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.heartbeat_sessions(spark, f"{d}/events.parquet")


_END_US = 1_706_572_800_000_000


@query(f"SELECT user_id AS key, max(epoch_us(ts)) AS last_us, max(epoch_us(ts)) + 86400000000 AS expire_us, CASE WHEN {_END_US} > max(epoch_us(ts)) + 86400000000 THEN 'expired' ELSE 'alive' END AS status FROM events GROUP BY 1")
def heartbeat_status(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    return E.alive_at(last, _END_US, 86_400)


@query("""WITH RECURSIVE o AS (SELECT user_id AS channel, event_id AS seq, 40 + length(props) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT channel, seq, n, size AS used, 0 AS part FROM o WHERE n = 1 UNION ALL
    SELECT o.channel, o.seq, o.n, CASE WHEN used + size > 1000 THEN size ELSE used + size END, CASE WHEN used + size > 1000 THEN part + 1 ELSE part END FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1)
  SELECT channel, seq, part FROM r""")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("seq"), (40 + F.length("props")).alias("size"))
    return E.rotate(e, 1000)
