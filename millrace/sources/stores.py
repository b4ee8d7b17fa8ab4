"""Stores: files, JSON rows, key-value tables, trees of paths, node folders, archives, pending events."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import fixed
from millrace.functions import text as T


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, modified, text)`` of the code files under a folder, with paths relative to it; ignored folders are left out."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(fixed.CODE_EXTENSIONS) + "}").load(root)
    path = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.regexp_replace("path", "^[a-z]+:/+", ""))
    named = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return named.where(T.is_code_path(F.col("path")))


def json_rows(texts: DataFrame, column: str, schema: StructType | str) -> DataFrame:
    """Rows from texts that hold one JSON object, an array of objects, or one object a line; missing fields become null.

    A text of several lines whose first one is an object is read line by line, and lines that are no object are left out;
    so are other texts that are no JSON.
    """
    t = F.trim(column)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    is_object = lambda x: F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))
    whole = F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
    parts = F.when((F.size(lines) > 1) & is_object(F.get(lines, F.lit(0))), F.filter(lines, is_object)).otherwise(F.from_json(F.when(F.try_parse_json(whole).isNotNull(), whole), "array<string>"))
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return texts.select(F.explode(parts).alias("json")).select(F.from_json("json", kind).alias("r")).where("r IS NOT NULL").select("r.*")


def event_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A log of one JSON object a line; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """A dataset of one JSON object a line; null fields are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def row_by_key(rows: DataFrame, key: str, value: object = None) -> DataFrame:
    """The row with a key; without one the first row by key."""
    return rows.orderBy(key).limit(1) if value is None else rows.where(F.col(key) == value).limit(1)


def catalog(spark: SparkSession) -> DataFrame:
    """``(database, name, temporary)`` of all tables and views of the session."""
    found = [(d.name, t.name, t.isTemporary) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)]
    return spark.createDataFrame(found, "database string, name string, temporary boolean").distinct()


def table_facts(rows: DataFrame) -> DataFrame:
    """``(position, name, type, rows)`` of the columns of a table."""
    n = rows.count()
    return rows.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), n) for i, f in enumerate(rows.schema)], "position int, name string, type string, rows long")


def without_tree(paths: DataFrame, folder: str) -> DataFrame:
    """Rows outside a folder and what lies in it; the root keeps only itself."""
    f = folder.rstrip("/")
    return paths.where(~((F.col("path") == f) | F.col("path").startswith(f + "/"))) if f else paths.where(F.col("path").isin("", "/"))


def key_listing(pairs: DataFrame) -> DataFrame:
    """``(name, size)`` of every key of ``pairs(key, value)`` by its last part, in bytes."""
    return pairs.select(F.element_at(F.split("key", "/"), -1).alias("name"), F.octet_length("value").alias("size"))


def with_renamed_key(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """One key under another name; an error where the old one is missing or the new one taken."""
    there = {r[0] for r in pairs.where(F.col("key").isin(old, new)).select("key").distinct().collect()}
    if old not in there or (new in there and new != old):
        raise KeyError(old if old not in there else f"{new} is taken")
    return pairs.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def nodes_of(files: DataFrame) -> DataFrame:
    """``(folder, content, abstract, overview, status)`` from ``files(path, text)``: the files of a node's folder side by side.

    Only nodes whose ``.meta.json`` calls them ACTIVE can be read.
    """
    parts = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.substring_index("path", "/", -1).alias("name"), "text")
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    node = parts.groupBy("folder").agg(pick("content.md").alias("content"), pick(".abstract.md").alias("abstract"), pick(".overview.md").alias("overview"), F.get_json_object(pick(".meta.json"), "$.status").alias("status"))
    return node.where("status = 'ACTIVE'")


def archives(entries: DataFrame, session: str) -> DataFrame:
    """The archives of a session without their messages, newest first by id."""
    return entries.where(F.col("session_id") == session).drop("messages").orderBy(F.desc("archive_id"))


def write_archive(spark: SparkSession, path: str, entry: dict[str, object], schema: StructType | str, now: Column | None = None) -> None:
    """Append one archive; its id is the time and a random part, so that ids sort by time."""
    ident = F.concat(F.date_format(now if now is not None else F.current_timestamp(), "yyyyMMddHHmmss"), F.lit("-" + uuid.uuid4().hex[:8]))
    row = spark.createDataFrame([entry], schema)
    row.withColumn("archive_id", F.coalesce(F.col("archive_id"), ident)).write.mode("append").parquet(path)


def due(events: DataFrame, now: Column) -> DataFrame:
    """Events that wait and whose time has come; one without a time is due."""
    return events.where((F.upper(F.trim("status")) == "PENDING") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def records_of(events: DataFrame, schema: StructType | str, required: Sequence[str] = ("id", "uri", "level", "text", "account_id", "owner_space")) -> DataFrame:
    """The records in ``events(event_id, payload)``, whose payload is JSON with a list ``records``; a record that lacks a
    required field is left out."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    kind = kind if kind.startswith("struct<") else f"struct<{kind}>"
    body = F.from_json("payload", f"struct<records:array<{kind}>>")["records"]
    rows = events.select("event_id", F.explode(body).alias("r")).select("event_id", "r.*")
    return rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in required)) if required else rows
