"""Readers for the engine's parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset folder ``sf_dir`` (one file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exactly(path: str) -> str:
    """A file pattern that only ``path`` fits: a stream can't read a single file by its name, but by a pattern."""
    p = path.rstrip("/")
    return re.sub(r"([*?\[\]{}])", r"\\\1", p[:-1]) + f"[{p[-1]}]"
