"""Hierarchical search: directories first, then what lies in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranking import cosine
from millrace.session import staged


def _once(scored: DataFrame, score: str) -> DataFrame:
    """Each id once; of unlike rows the most similar."""
    rest = [c for c in scored.columns if c != "id"]
    return scored.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct(score, "uri")).alias("r")).select("id", "r.*")


def seeds(records: DataFrame, vector: Sequence[float], n: int) -> DataFrame:
    """The ``n`` records most similar to the vector, over all levels: ``(id, uri, level, parent_uri, score)``."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    scored = records.select("id", "uri", "level", "parent_uri", cosine(F.col("embedding"), v).alias("score"))
    return _once(scored, "score").orderBy(F.desc("score"), "id").limit(n)


def hierarchical(
    records: DataFrame, vector: Sequence[float], *, limit: int = 10, seed: int = 30, alpha: float = 0.5, threshold: float = 0.0, quiet: int = 3, depth: int = 64
) -> DataFrame:
    """``(uri, score)`` of the best leaves and directories, found by expanding directories level by level.

    A child scores ``alpha`` times its own similarity plus the rest from its parent (its own alone under a parent of
    score 0) and is dropped at or below ``threshold``; leaves among the seeds keep their own score. A level is expanded
    at once, not one directory at a time, so that each level is one join; what is found is a superset of what a
    best-first walk finds before it stops. It ends when a level adds nothing or the best ``limit`` stay the same
    ``quiet`` times.
    """
    v = F.array(*[F.lit(float(x)) for x in vector])
    start = staged(seeds(records, vector, seed), "seeds")
    found = start.where("level = 2").groupBy("uri").agg(F.max("score").alias("score"))
    frontier = start.where("level < 2").groupBy("uri").agg(F.max("score").alias("score"))
    children = records.where("parent_uri IS NOT NULL").select("id", "uri", "level", F.regexp_replace("parent_uri", "/+$", "").alias("parent"), cosine(F.col("embedding"), v).alias("own"))
    children = _once(children, "own")
    seen, same, before = frontier.select("uri"), 0, None
    for _ in range(depth):
        step = frontier.select(F.regexp_replace("uri", "/+$", "").alias("parent"), F.col("score").alias("up")).join(children, "parent")
        score = F.when(F.col("up") == 0, F.col("own")).otherwise(alpha * F.col("own") + (1 - alpha) * F.col("up"))
        got = staged(step.select("uri", "level", score.alias("score")).where(F.col("score") > threshold).groupBy("uri").agg(F.max("score").alias("score"), F.min("level").alias("level")), "level")
        found = staged(found.union(got.select("uri", "score")).groupBy("uri").agg(F.max("score").alias("score")), "found")
        frontier = staged(got.where("level < 2").join(seen, "uri", "left_anti").select("uri", "score"), "frontier")
        best = [r["uri"] for r in found.orderBy(F.desc("score"), "uri").limit(limit).collect()]
        same = same + 1 if best == before else 0
        before = best
        if same >= quiet or not frontier.limit(1).count():
            break
        seen = seen.union(frontier.select("uri"))
    return found.orderBy(F.desc("score"), "uri").limit(limit)


def starting_points(hits: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits split into leaves and unique directories; roots that no hit names join the directories with score 0."""
    leaves = hits.where("level = 2")
    folders = hits.where("level < 2").groupBy("uri").agg(F.max("score").alias("score"))
    rest = roots.select("uri").distinct().join(folders, "uri", "left_anti").select("uri", F.lit(0.0).alias("score"))
    return leaves, folders.union(rest)
