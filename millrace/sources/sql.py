"""SQL text over the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.tables import table

READS = ("select", "with", "show", "describe", "explain")


def run(spark: SparkSession, sf_dir: str, tables: Sequence[str], text: str) -> DataFrame:
    """Run one reading statement with the named tables as views."""
    if not text.strip().lower().startswith(READS):
        raise ValueError("only reading statements")
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
