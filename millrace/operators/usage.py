"""Statistics of tool calls, groups of like lines, and sums rolled up a tree of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.functions import text as T


def tool_stats(calls: DataFrame, by: str = "session") -> DataFrame:
    """``(by, tool, calls, good, bad, ms, tokens)`` from ``calls(by, tool, status, ms, tokens)``.

    A call is good when its status is completed or success; calls of no tool are left out, missing times and tokens count 0.
    """
    good = F.coalesce(F.col("status").isin("completed", "success"), F.lit(False))
    named = calls.where(F.coalesce("tool", F.lit("")) != "")
    return named.groupBy(by, "tool").agg(
        F.count("*").alias("calls"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.sum(F.coalesce("ms", F.lit(0))).alias("ms"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")
    )


def tool_report(stats: DataFrame, by: str = "session") -> DataFrame:
    """``(by, report)``: a line for each tool, the most used first, ties by name."""
    line = F.concat(F.lit("- "), F.col("tool"), F.lit(": "), F.col("calls").cast("string"), F.lit(" calls, "), F.col("good").cast("string"), F.lit(" good, "), F.col("bad").cast("string"), F.lit(" bad"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("k"), "tool", line.alias("line"))))
    return stats.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


def line_templates(texts: DataFrame, patterns: tuple[str, ...], key: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(template, lines, texts, example)``: lines that begin with one of the patterns, grouped by what is left when what
    varies in them is taken out. ``key`` is the template of a column ``line`` (that of errors by default). Counts combine
    before they are shuffled, so a template that a third of all lines has is one row a task."""
    rows = texts.select(id_col, F.explode(F.filter(L.lines(F.col(text_col)), lambda x: T.begins(x, patterns))).alias("raw")).select(id_col, F.trim("raw").alias("line"))
    made = rows.select(id_col, "line", (T.error_key(F.col("line")) if key is None else key).alias("template"))
    inside = made.groupBy("template", id_col).agg(F.count("*").alias("n"), F.min("line").alias("example"))
    return inside.groupBy("template").agg(F.sum("n").alias("lines"), F.count("*").alias("texts"), F.min("example").alias("example"))


def rolled_up(leaves: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``(folder, files, <sums>)`` for every folder over ``leaves(path, ...)``: each file counts in all folders above it, and
    the root is the empty path. One aggregation, combined before the shuffle; no level waits for the one below."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    folders = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    rows = leaves.where("path IS NOT NULL").select(F.explode(folders).alias("folder"), *[c.alias(n) for n, c in sums.items()])
    return rows.groupBy("folder").agg(F.count("*").alias("files"), *[F.sum(n).alias(n) for n in sums])
