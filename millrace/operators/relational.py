"""Joins, merges and deltas on records, edges and chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(records: DataFrame, account_id: str, owner_spaces: Sequence[str] | None = None) -> DataFrame:
    """The records of one tenant, optionally of some owner spaces; a trailing slash of ``owner_space`` does not matter."""
    df = records.where(F.col("account_id") == account_id)
    if owner_spaces is None:
        return df
    return df.where(F.regexp_replace("owner_space", "/+$", "").isin([s.rstrip("/") for s in owner_spaces]))


def matching(records: DataFrame, **filters: object) -> DataFrame:
    """AND over equality (scalar) and membership (list) filters; names that are no columns are ignored."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in filters.items() if k in records.columns]
    return records.where(reduce(lambda a, b: a & b, tests)) if tests else records


def without_ids(records: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The records whose key is not among those of ``gone``; a null key stays."""
    return records.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*records.columns)


def without_owner(records: DataFrame, account_id: str, owner_space: str) -> DataFrame:
    """The records that do not belong to an owner space of an account."""
    own = (F.col("account_id") == account_id) & (F.regexp_replace("owner_space", "/+$", "") == owner_space.rstrip("/"))
    return records.where(~F.coalesce(own, F.lit(False)))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row a key, the greatest by ``order``: an aggregation, so a hot key is reduced before it is shuffled."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, arriving: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``arriving`` replace those of ``current`` with the same key."""
    both = current.withColumn("__new", F.lit(0)).unionByName(arriving.withColumn("__new", F.lit(1)))
    return latest(both, keys, [F.col("__new")]).drop("__new")


def top_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    """For each node its ``n`` heaviest distinct outgoing edges; a missing weight counts 0, ties go to the smaller target."""
    once = edges.groupBy("from_uri", "to_uri", "relation_type").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    item = F.struct((-F.col("weight")).alias("w"), "to_uri", "relation_type")
    top = once.groupBy("from_uri").agg(F.slice(F.array_sort(F.collect_list(item)), 1, n).alias("top"))
    return top.select("from_uri", F.posexplode("top").alias("at", "t")).select(
        "from_uri", (F.col("at") + 1).alias("rank"), F.col("t.to_uri").alias("to_uri"), F.col("t.relation_type").alias("relation_type"), (-F.col("t.w")).alias("weight")
    )


def leaf(name: Column) -> Column:
    """The last part of a dotted name in lower case."""
    return F.lower(F.substring_index(name, ".", -1))


def resolve_symbols(chunks: DataFrame) -> DataFrame:
    """``(source, relation, name, target)``: names that a chunk calls, extends or contains, led to chunks of its
    repository that define them; a chunk never leads to itself."""
    kinds = F.array(*[F.struct(F.lit(k).alias("relation"), F.coalesce(F.col(f"graph.{k}"), F.array().cast("array<string>")).alias("names")) for k in ("calls", "extends", "contains")])
    asked = (
        chunks.select("repo", F.col("chunk_id").alias("source"), F.explode(kinds).alias("g"))
        .select("repo", "source", F.col("g.relation").alias("relation"), F.explode("g.names").alias("name"))
        .distinct()
        .withColumn("key", leaf(F.col("name")))
    )
    defined = chunks.where("symbol IS NOT NULL").select("repo", F.col("chunk_id").alias("target"), leaf(F.col("symbol")).alias("key")).distinct()
    return asked.join(defined, ["repo", "key"]).where("source <> target").select("source", "relation", "name", "target").distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Keys that were added (A), modified (M) or deleted (D) between two snapshots."""
    o = old.select(*keys, F.col(digest).alias("was"), F.lit(True).alias("in_old"))
    n = new.select(*keys, F.col(digest).alias("now"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(~F.col("was").eqNullSafe(F.col("now")), "M")
    return o.join(n, list(keys), "full_outer").select(*keys, change.alias("change")).where("change IS NOT NULL")


def levels(nodes: DataFrame) -> DataFrame:
    """A node becomes up to three records (abstract, overview, content); blank texts give none, level 2 has its own address."""
    item = lambda n, c, u: F.struct(F.lit(n).alias("level"), F.col(c).alias("text"), u.alias("record_uri"))
    all_ = F.array(item(0, "abstract", F.col("uri")), item(1, "overview", F.col("uri")), item(2, "content", F.concat("uri", F.lit("/content.md"))))
    return nodes.select("uri", F.explode(all_).alias("r")).select("uri", "r.*").where("trim(text) <> ''")
