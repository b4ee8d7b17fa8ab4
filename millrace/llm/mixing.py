"""Mixing sources to target weights.

Tokens are counted once per document and summed per source. From the sums
follows a repetition rate for each source of a mix; a document is emitted
floor(rate) times, and once more when a hash of its id, the mix and the seed
falls below the fraction. No row is compared with another, so nothing but the
sums (one row a source) is shuffled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies of fifty thousand tokens cut a text before its pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 42
SMALL = 100_000  # rows of a mix table that may be broadcast; a larger one is joined by a shuffle


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(tokenizer: str = TOKENIZER, pattern: str = PATTERN):
    """A column function: the number of tokens of a text under the ranks file ``tokenizer``, which every executor has; null counts 0."""

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer, pattern)
        for texts in parts:
            yield pd.Series([len(t) for t in encoder.encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1)], dtype="int64")

    return count


def rates(spark: SparkSession, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_name, source, target_share, tokens, rate, planned)`` from ``sizes(source, tokens)`` and the mix table.

    The size of a mix is the tokens its sources hold together. Each source is to supply its weight of it (weights
    are scaled to sum 1). A source that would need more than ``max_repeat`` repetitions supplies that many, and what
    is missing is spread over the others by weight, until no further source meets its cap; a source without
    documents supplies nothing. The mix table has one row a source of a mix and is small by nature: it alone, with
    the sums of its sources, comes to the driver. Rows without a mix, a source or a positive weight are left out, a
    missing cap is no cap, and repeated rows of a mix and source count once (the largest weight and cap).
    """
    wanted = targets.where("mix_name IS NOT NULL AND source IS NOT NULL AND target_share > 0").groupBy("mix_name", "source").agg(
        F.max("target_share").alias("w"), F.max("max_repeat").alias("cap")
    )
    rows = [r.asDict() for r in wanted.join(sizes, "source", "left").select("mix_name", "source", "w", "cap", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()]
    out = []
    for mix in sorted({r["mix_name"] for r in rows}):
        own = sorted((r for r in rows if r["mix_name"] == mix), key=lambda r: r["source"])
        total, weights = float(sum(r["tokens"] for r in own)), sum(r["w"] for r in own)
        most = {r["source"]: r["tokens"] * (float("inf") if r["cap"] is None else r["cap"]) if r["tokens"] else 0.0 for r in own}
        planned: dict[str, float] = {}
        open_ = list(own)
        while open_:
            left, w = total - sum(planned.values()), sum(r["w"] for r in open_)
            full = [r for r in open_ if left * r["w"] / w > most[r["source"]]]
            if not full:
                planned |= {r["source"]: left * r["w"] / w for r in open_}
                break
            planned |= {r["source"]: most[r["source"]] for r in full}
            open_ = [r for r in open_ if r["source"] not in planned]
        for r in own:
            p = planned[r["source"]]
            out.append((mix, r["source"], r["w"] / weights, r["tokens"], p / r["tokens"] if r["tokens"] else 0.0, p))
    return spark.createDataFrame(out, "mix_name string, source string, target_share double, tokens long, rate double, planned double")


def mixed(docs: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, pattern: str = PATTERN, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the report of shares.

    ``drawn(mix_name, source, doc_id, copy, tokens)`` has one row for each emitted copy (copies count from 0).
    ``report(mix_name, source, target_share, rate, tokens, drawn_tokens, actual_share)`` has one row for each
    source of a mix, also for those that supply nothing. A repeated ``doc_id`` counts once (of unlike rows the first by source, then the shorter); rows without an id or a
    source are left out; an empty text has 0 tokens and is drawn like any other. The draw depends on id, mix and
    seed only, so it is the same on any partitioning. Empty tables give empty results.
    """
    spark = docs.sparkSession
    sent = lambda rows: F.broadcast(rows) if rows.count() <= SMALL else rows
    counted = staged(
        docs.where("doc_id IS NOT NULL AND source IS NOT NULL")
        .join(sent(targets.select("source").distinct()), "source", "left_semi")
        .select("doc_id", "source", token_count(tokenizer, pattern)(F.col("text")).alias("tokens"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "tokens")).alias("r"))
        .select("doc_id", "r.*"),
        "tokens",
    )
    plan = rates(spark, counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), targets)
    unit = (F.xxhash64(F.lit(seed), "mix_name", "doc_id").bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    drawn = (
        counted.join(sent(plan.select("mix_name", "source", "rate")), "source")
        .withColumn("copies", copies)
        .where("copies > 0")
        .select("mix_name", "source", "doc_id", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"), "tokens")
    )
    got = drawn.groupBy("mix_name", "source").agg(F.sum("tokens").alias("drawn_tokens"))
    whole = drawn.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    report = (
        plan.join(got, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select(
            "mix_name", "source", "target_share", "rate", "tokens", F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"),
            F.coalesce(F.try_divide("drawn_tokens", "all"), F.lit(0.0)).alias("actual_share"),
        )
    )
    return drawn, report
