"""Queries for names and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.plans.registry import Registry
from millrace.sources.tables import table
from millrace.streaming import queues as Q

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

_SPAN = "CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN start_line || '{0}' || end_line ELSE '0{0}0' END"
_NAME = "coalesce(nullif(symbol, ''), 'symbol')"
_BASE = "string_split(file_path, '/')[-1]"
_IDENT = "coalesce(nullif(regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'code_chunk')"


@query(rf"""SELECT chunk_id, regexp_replace(substr({_IDENT.format(rf"concat_ws('_', coalesce(language, 'unknown'), regexp_replace({_BASE}, '\.[^.]*$', ''), {_NAME}, {_SPAN.format('_')})")}, 1, 96), '_+$', '') || '_' ||
    substr(sha1(concat_ws(':', coalesce(language, 'unknown'), file_path, {_NAME}, {_SPAN.format('-')})), 1, 16) AS slug, {_IDENT.format("file_path")} AS identity,
  {_BASE} || ' ' || file_path || CASE WHEN replace(replace(file_path, '/', '_'), '.', '_') = file_path THEN '' ELSE ' ' || replace(replace(file_path, '/', '_'), '.', '_') END || CASE WHEN contains({_BASE}, '.') THEN ' ' || replace({_BASE}, '.', '_') || ' ' || regexp_replace({_BASE}, '\.[^.]*$', '') ELSE '' END AS question,
  md5(array_to_string(string_split(content, chr(10))[2:4], chr(10))) AS lines FROM code_chunk""")
def chunk_names(spark: SparkSession, d: str) -> DataFrame:
    c, p = F.col, F.col("file_path")
    return table(spark, d, "code_chunk").select(
        "chunk_id", N.code_slug(c("language"), p, c("symbol"), c("start_line"), c("end_line")).alias("slug"), N.identity(p).alias("identity"), N.path_question(p, F.lit(None).cast("string")).alias("question"),
        F.md5(N.some_lines(c("content"), F.lit(2), F.lit(4))).alias("lines"),
    )


_FOLDER = "^ctx://([^/]+)/((?:users|agents)/[^/]+/memories(?:/[^/]+){0,2}|agents/[^/]+/skills/[^/]+|sessions/[^/]+/history(?:/[^/]+)?)/*$"


@query(rf"""SELECT id, CASE WHEN regexp_matches(uri, '{_FOLDER}') THEN '/accounts/' || regexp_extract(uri, '{_FOLDER}', 1) || '/' || regexp_extract(uri, '{_FOLDER}', 2) || '/' END AS folder,
  CASE WHEN embedding IS NOT NULL THEN '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', CAST(x AS DOUBLE))), ',') || ']' END AS literal, right(coalesce(text, ''), 20) AS newest FROM index_record""")
def record_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_record").select("id", N.folder_of(F.col("uri")).alias("folder"), N.vector_literal(F.col("embedding")).alias("literal"), N.newest(F.col("text"), 20).alias("newest"))


@query("SELECT queue_name, id FROM queue_messages QUALIFY row_number() OVER (PARTITION BY queue_name ORDER BY id DESC) <= 100")
def queue_retained(spark: SparkSession, d: str) -> DataFrame:
    """What a reader that joins late is given: the last hundred of each queue."""
    return Q.retained(table(spark, d, "queue_messages"), "queue_name", "id", 100)
