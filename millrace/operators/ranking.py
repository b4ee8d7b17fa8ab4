"""Ranking: field-weighted BM25, symbol scores, fusion, cut-offs, vectors and the link graph."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import fixed
from millrace.functions import text as T
from millrace.session import staged

def _query_tokens(query: str) -> list[str]:
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", query) if w.lower() not in fixed.STOPWORDS]


def bm25f(docs: DataFrame, query: str, fields: dict[str, tuple[float, float]] = fixed.BM25_FIELDS, k1: float = 1.5) -> DataFrame:
    """``(doc, score)`` of documents with a positive score; ``docs`` has a column ``doc`` and one for each field.

    Only the terms of the query are counted, inside the row, so what is shuffled is a handful of numbers: one pass
    gathers lengths and document frequencies (one row for each field and term), a second scores. Repeated query terms
    count as often as they occur.
    """
    terms = _query_tokens(query)
    distinct = sorted(set(terms))
    if not distinct:
        return docs.select("doc", F.lit(0.0).alias("score")).where("false")
    asked = F.array(*map(F.lit, distinct))
    tf = lambda toks: F.transform(asked, lambda q: F.size(F.filter(toks, lambda t: t == q)))
    counted = docs.select("doc", *[T.let(T.index_tokens(F.coalesce(F.col(f), F.lit(""))), lambda t: F.struct(F.size(t).alias("n"), tf(t).alias("tf"))).alias(f) for f in fields])
    sums = [F.count("*").alias("docs")]
    for f in fields:
        sums.append(F.sum(f"{f}.n").alias(f"len_{f}"))
        sums += [F.count_if(F.col(f"{f}.tf")[i] > 0).alias(f"df_{f}_{i}") for i in range(len(distinct))]
    stats = counted.agg(*sums).first()  # one number for each field and term
    docs_n = stats["docs"]
    score = F.lit(0.0)
    for f, (weight, b) in fields.items():
        average = max((stats[f"len_{f}"] or 0) / max(1, docs_n), 1e-9)
        norm = k1 * (1 - b + b * F.col(f"{f}.n") / average)
        for i, t in enumerate(distinct):
            n, df = F.col(f"{f}.tf")[i], stats[f"df_{f}_{i}"]
            if df:
                idf = math.log(1 + (docs_n - df + 0.5) / (df + 0.5))
                score = score + F.when(n > 0, terms.count(t) * weight * idf * n * (k1 + 1) / (n + norm)).otherwise(0.0)
    return counted.select("doc", score.alias("score")).where("score > 0")


def symbol_score(symbol: Column, signature: Column, path: Column, kind: Column, query: str) -> Column:
    """Equal to the symbol 3, inside it 1.5, in the signature 1, in the path 0.6 for each term; 0.8 once for a word of its kind."""
    terms = list(dict.fromkeys(w for w in _query_tokens(query) if len(w) > 2))
    s, g, p = (F.lower(F.coalesce(c, F.lit(""))) for c in (symbol, signature, path))
    score = F.lit(0.0)
    for t in terms:
        score = score + F.when(s == t, 3.0).when(s.contains(t), 1.5).otherwise(0.0) + F.when(g.contains(t), 1.0).otherwise(0.0) + F.when(p.contains(t), 0.6).otherwise(0.0)
    named = [k for k, words in fixed.KIND_WORDS.items() if set(words) & set(terms)]
    return score + F.when(F.coalesce(kind, F.lit("code")).isin(named or [""]), 0.8).otherwise(0.0)


def top(scored: DataFrame, n: int, id_col: str = "doc") -> DataFrame:
    """The ``n`` best by score, ties by id, with their rank (a top-k in every partition, then one of n x partitions rows)."""
    best = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc(id_col))))


def reciprocal_rank_fusion(routes: dict[str, DataFrame], weights: dict[str, float] = fixed.ROUTE_WEIGHTS, k: int = 60, id_col: str = "doc") -> DataFrame:
    """Sum of weight / (k + rank) over the routes' ranked lists."""
    parts = [df.select(id_col, F.lit(weights.get(n, 0.0)).alias("w"), "rank") for n, df in routes.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(id_col).agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"))


def min_max(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Scores brought to 0..1 within each group; all equal become 1."""
    lo, hi = F.min("score").alias("lo"), F.max("score").alias("hi")
    if group:
        joined = scored.join(scored.groupBy(*group).agg(lo, hi), list(group))
    else:
        ends = scored.agg(lo, hi).first()
        joined = scored.withColumns({"lo": F.lit(ends["lo"]), "hi": F.lit(ends["hi"])})
    return joined.withColumn("score", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)).drop("lo", "hi")


def score_gap(scored: DataFrame, group: str, order: Sequence[Column], keep: int = 3, ratio: float = 0.15) -> DataFrame:
    """Within each group, cut behind the largest relative drop from rank ``keep`` on, if it is at least ``ratio``; the first of equal drops."""
    w = W.partitionBy(group).orderBy(*order)
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    gap = F.when((F.col("rank") >= keep) & F.col("next").isNotNull() & (F.col("score") > 0), (F.col("score") - F.col("next")) / F.col("score"))
    cut = ranked.groupBy(group).agg(F.max_by(F.struct(gap.alias("gap"), "rank"), F.struct(F.coalesce(gap, F.lit(-1.0)), -F.col("rank"))).alias("c"))
    end = F.when(F.col("c.gap") >= ratio, F.col("c.rank")).otherwise(F.lit(2147483647))
    return ranked.join(cut.select(group, end.alias("last")), group).where("rank <= last").drop("next", "last")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for a zero, null or differently sized vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def nearest(records: DataFrame, vector: Sequence[float], n: int, id_col: str = "id") -> DataFrame:
    """The ``n`` records most similar to one vector."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    return top(records.withColumn("score", cosine(F.col("embedding"), v)), n, id_col)


def page_rank(edges: DataFrame, seeds: DataFrame, *, restart: float = 0.35, rounds: int = 14) -> DataFrame:
    """``(node, rank)``: a walk over weighted ``edges(src, dst, weight)`` that restarts at ``seeds(node, mass)``.

    Mass at nodes without outgoing weight is dropped. Every fourth round is written to the shared folder.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total")).where("total > 0")
    share = staged(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "shares")
    whole = seeds.agg(F.sum("mass")).first()[0] or 1.0
    start = staged(seeds.select("node", (F.col("mass") / whole).alias("base")), "seeds")
    rank = start.select("node", F.col("base").alias("rank"))
    for i in range(rounds):
        moved = share.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        rank = start.join(moved, "node", "full_outer").select("node", (restart * F.coalesce("base", F.lit(0.0)) + (1 - restart) * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if i % 4 == 3:
            rank = staged(rank, "rank")
    return rank
