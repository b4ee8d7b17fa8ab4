"""Queries on the message table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.streaming import exactly_once as eo


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eo.repeated(spark, f"{sf_dir}/queue_messages.parquet")


def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eo.unique_messages(spark, f"{sf_dir}/queue_messages.parquet")


_TRIM = r"regexp_replace(message_id, '^\s+|\s+$', '', 'g')"
_KEY = f"CASE WHEN {_TRIM} <> '' THEN lower({_TRIM}) END"

SQL = {
    "p5_found": f"""
        SELECT queue_name, {_KEY} AS message_id FROM queue_messages WHERE {_KEY} IS NOT NULL
        GROUP BY queue_name, {_KEY} HAVING count(*) > 1""",
    "p5_messages": f"""
        SELECT id, queue_name, message_id, data, timestamp, status, processing_started_at, batch_no FROM (
          SELECT *, row_number() OVER (PARTITION BY queue_name, {_KEY} ORDER BY id) AS n FROM queue_messages)
        WHERE n = 1 OR {_KEY} IS NULL""",
}
QUERIES = {"p5_found": p5_found, "p5_messages": p5_messages}
