"""Code search end to end: candidate files, four ranked routes, fusion and top-up.

Ranks over a whole table are numbered partition by partition after a range sort, so no route passes through one task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import fixed
from millrace.functions import text as T
from millrace.operators import ranking as K
from millrace.operators.relational import resolve_symbols
from millrace.session import staged

# What an anchor, a walk and the fusion of both count.
EXACT, IN_SYMBOL, IN_SIGNATURE, IN_PATH, IN_RELATIONS, PER_LINK, MOST_LINKS, IN_TEXT, OF_RELATIONS = 6.0, 2.5, 1.8, 1.4, 1.6, 0.25, 4, 0.75, 0.25
HOP, FORWARD, BACKWARD, AGAINST = 0.7, 0.95, 0.72, 0.72
RESTART, ROUNDS, RANK_BASE = 0.35, 14, 60
ANCHOR, TERM_IN_PATH, TERM_IN_TEXT, MOST_HITS, TERM_IN_NAME = 8, 20, 5, 5, 10


def terms_of(query: str) -> list[str]:
    """The distinct words of three or more characters of a query, without stop words, in lower case."""
    return list(dict.fromkeys(w for w in K._query_tokens(query) if len(w) > 2))


def words_of(query: str) -> list[str]:
    """The same words in their first spelling, for literal search."""
    first: dict[str, str] = {}
    for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", query):
        first.setdefault(w.lower(), w)
    return [w for low, w in first.items() if low not in fixed.STOPWORDS]


def ranked(scored: DataFrame, id_col: str = "doc") -> DataFrame:
    """``scored(id, score)`` with ``rank`` from 1, best first, ties by id: rows are numbered inside the ranges of a
    distributed sort, and each range starts where the sizes of those before it end (one row a range)."""
    parts = staged(scored.orderBy(F.desc("score"), F.asc(id_col)).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = parts.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).select("range", "before")
    own = F.row_number().over(W.partitionBy("range").orderBy(F.desc("score"), F.asc(id_col)))
    return parts.withColumn("own", own).join(sizes, "range").withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "range")


def links_of(chunks: DataFrame) -> DataFrame:
    """``(src, dst)``: chunks that a chunk's calls, bases and contents lead to, each once."""
    return resolve_symbols(chunks).select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def anchors(chunks: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """``(doc, score)``: how well a chunk itself fits a query, by symbol, signature, path, text and what it is linked to.

    ``chunks(chunk_id, symbol, signature, file_path, content, graph)``; a null text holds no term.
    """
    terms = terms_of(query)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    held = lambda text: reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms])
    symbol, signature, path = F.trim(low("symbol")), F.trim(low("signature")), F.trim(low("file_path"))
    names = F.lower(F.array_join(F.flatten(F.filter(F.array(*[F.col(f"graph.{k}") for k in ("calls", "imports", "extends", "contains")]), lambda x: x.isNotNull())), " "))
    whole = F.concat_ws(" ", low("file_path"), low("symbol"), low("signature"), low("content"))
    degree = links.select(F.explode(F.array("src", "dst")).alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("links"))
    anchor = F.when(symbol.isin(terms), EXACT).otherwise(0.0) + IN_SYMBOL * held(symbol) + IN_SIGNATURE * held(signature) + IN_PATH * held(path)
    counted = chunks.select("chunk_id", anchor.alias("anchor"), (IN_RELATIONS * held(F.coalesce(names, F.lit("")))).alias("named"), (IN_TEXT * held(whole)).alias("text"))
    around = F.col("named") + F.least(F.coalesce("links", F.lit(0)), F.lit(MOST_LINKS)) * PER_LINK
    score = F.greatest("anchor", "text", F.when(around > 0, F.col("anchor") + OF_RELATIONS * around).otherwise(0.0))
    return counted.join(degree, "chunk_id", "left").select(F.col("chunk_id").alias("doc"), score.alias("score")).where("score > 0")


def one_hop(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc, score)``: seeds and what lies one link away, forward or backward, with the greatest gain."""
    seed = seeds.select(F.col("doc").alias("at"), "score")
    ahead = links.join(seed, F.col("src") == F.col("at")).select(F.col("dst").alias("doc"), (F.col("score") * HOP * FORWARD).alias("score"))
    back = links.join(seed, F.col("dst") == F.col("at")).select(F.col("src").alias("doc"), (F.col("score") * HOP * BACKWARD * AGAINST).alias("score"))
    return seeds.select("doc", "score").union(ahead).union(back).groupBy("doc").agg(F.max("score").alias("score"))


def graph_rank(chunks: DataFrame, query: str) -> DataFrame:
    """``(doc, score)``: anchors, their one-hop walk and a walk that restarts at them, fused by their ranks.

    A query without terms gives an empty result, as do chunks that no term touches.
    """
    if not terms_of(query):
        return chunks.select(F.col("chunk_id").alias("doc"), F.lit(0.0).alias("score")).where("false")
    links = staged(links_of(chunks), "links")
    seeds = staged(anchors(chunks, links, query), "anchors")
    mass = K.min_max(seeds).select(F.col("doc").alias("node"), F.col("score").alias("mass"))
    walked = K.page_rank(links.withColumn("weight", F.lit(1.0)), mass, restart=RESTART, rounds=ROUNDS)
    lists = (seeds, one_hop(seeds, links), walked.select(F.col("node").alias("doc"), F.round("rank", 12).alias("score")).where("score > 0"))
    parts = [ranked(x.withColumn("score", F.round("score", 12))).select("doc", (1.0 / (RANK_BASE + F.col("rank"))).alias("s")) for x in lists]
    return reduce(DataFrame.union, parts).groupBy("doc").agg(F.sum("s").alias("score"))


def fused_with_top_up(routes: dict[str, DataFrame], n: int, each: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """``(position, doc, score, filled)``: the ``each`` best of every route fused by weighted ranks; where these are fewer
    than ``n``, the next of the routes in their order follow, each document once.

    ``routes`` are ``(doc, score)`` tables in the order in which they fill; what is sorted at the end is a few rows.
    """
    deep = [K.top(r.select("doc", "score"), n + each * len(routes)) for r in routes.values()]
    deep = staged(reduce(DataFrame.union, [x.select("doc", "rank", F.lit(i).alias("route")) for i, x in enumerate(deep)]), "routes")
    first = {name: deep.where((F.col("route") == i) & (F.col("rank") <= each)) for i, name in enumerate(routes)}
    best = K.reciprocal_rank_fusion(first, *([weights] if weights else [])).select("doc", F.round("score", 9).alias("score"))
    rest = deep.join(best, "doc", "left_anti").groupBy("doc").agg(F.min(F.struct("route", "rank")).alias("at"))
    rows = best.select(F.lit(False).alias("filled"), (-F.col("score")).alias("k1"), F.lit(0).alias("k2"), "doc", "score").union(
        rest.select(F.lit(True), F.col("at.route").cast("double"), F.col("at.rank"), "doc", F.lit(0.0))
    )
    order = ["filled", "k1", "k2", "doc"]
    return rows.orderBy(*order).limit(n).select(F.row_number().over(W.orderBy(*order)).alias("position"), "doc", "score", "filled")


def glob_pattern(pattern: str) -> str:
    """A path pattern (``*`` inside a folder, ``**`` over folders, ``?``, ``[..]``) as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def _first_paths(files: DataFrame, tests: Sequence[Column], n: int) -> list[list[str]]:
    """For each test the ``n`` first paths that pass it; one scan, lists bounded in every task."""
    if not tests:
        return []
    hits = files.select("path", F.explode(F.filter(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]), lambda x: x.isNotNull())).alias("test")).distinct()
    part = hits.groupBy("test", F.pmod(F.xxhash64("path"), F.lit(64)).alias("s"), F.spark_partition_id().alias("p")).agg(F.slice(F.sort_array(F.collect_list("path")), 1, n).alias("paths"))
    rows = part.groupBy("test").agg(F.slice(F.sort_array(F.flatten(F.collect_list("paths"))), 1, n).alias("paths")).collect()
    found = {r["test"]: r["paths"] for r in rows}
    return [found.get(i, []) for i in range(len(tests))]


def candidate_files(files: DataFrame, query: str, *, globs: Sequence[str] = (), terms: Sequence[str] = (), limit: int = 80) -> list[str]:
    """Paths of ``files(path, text)`` worth ranking: those that globs name, then those that hold a term literally.

    Each term (those of the query where none is given) adds up to ``max(limit, min(3 * limit, 200))`` paths that are not
    there yet. Where nothing is found the first six terms of the query are looked for. Of all at most
    ``max(limit, min(4 * limit, 300))`` stay, so that this bounded list may come to the driver. Paths come in byte order.
    """
    asked = [t for t in terms if t] or words_of(query)
    each, cap = max(limit, min(3 * limit, 200)), max(limit, min(4 * limit, 300))
    code = files.where(T.is_code_path(F.col("path")))
    globs = [g.strip() for g in globs if g.strip()]
    deepest = each * max(1, len(asked)) + limit
    named = _first_paths(code, [F.col("path").rlike(glob_pattern(g)) for g in globs], limit * max(1, len(globs)))
    found: dict[str, None] = {}
    for paths in named:
        for p in paths:
            if len(found) < limit:
                found.setdefault(p)
    if limit - len(found) > 0:
        for paths in _first_paths(code, [F.col("text").contains(t) for t in asked], deepest):
            fresh = [p for p in paths if p not in found][:each]
            found |= dict.fromkeys(fresh)
    if not found:
        for paths in _first_paths(code, [F.col("text").contains(t) for t in words_of(query)[:6]], limit):
            found |= dict.fromkeys(paths[: max(0, limit - len(found))])
    return list(found)[:cap]


def file_score(files: DataFrame, candidates: Sequence[str], query: str, *, globs: Sequence[str] = (), terms: Sequence[str] = (), limit: int = 80) -> DataFrame:
    """``(path, score)`` of the ``limit`` best of a bounded list of candidates, by what path and text show of the terms."""
    asked = [t.lower() for t in ([t for t in terms if t] or terms_of(query))]
    path, text = F.lower("path"), F.lower(F.coalesce("text", F.lit("")))
    heads = [g.split("*", 1)[0].strip("/").lower() for g in globs]
    none = F.lit(0)
    in_path = reduce(lambda a, b: a + b, [F.when(path.startswith(h), ANCHOR).otherwise(0) for h in heads if h] + [F.when(path.contains(t), TERM_IN_PATH).otherwise(0) for t in asked], none)
    hits = lambda t: F.floor((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t))
    in_text = reduce(lambda a, b: a + b, [F.least(hits(t), F.lit(MOST_HITS)) * TERM_IN_TEXT for t in asked[:8]], none)
    name = F.substring_index(path, "/", -1)
    in_name = F.when(reduce(lambda a, b: a | b, [name.contains(t) for t in asked], F.lit(False)), TERM_IN_NAME).otherwise(0)
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col("path")) if candidates else F.lit(0)
    rows = files.where(F.col("path").isin(list(candidates))).select("path", in_path.alias("in_path"), in_text.alias("in_text"), in_name.alias("in_name"), place.alias("place"))
    score = F.col("in_path") + F.col("in_text") + F.col("in_name")
    return rows.select("path", score.cast("int").alias("score"), "in_path", "in_text", "place").orderBy(F.desc("score"), F.desc("in_path"), F.desc("in_text"), "place").limit(limit).select("path", "score")


def context_hits(files: DataFrame, query: str, *, limit: int = 5, around: int = 2) -> DataFrame:
    """``(rank, path, term, line, excerpt, score)``: the first matching line of a file with the lines around it.

    The first four terms of the query are looked for one after the other, each file counts for the first of them, in order
    of path, until ``limit`` files are found; the score falls by a tenth from rank to rank and ends at a tenth.
    """
    asked = words_of(query)[:4]
    code = files.where(T.is_code_path(F.col("path")))
    taken: dict[str, str] = {}
    for term, paths in zip(asked, _first_paths(code, [F.col("text").contains(t) for t in asked], limit * len(asked)) if asked else []):
        for p in paths:
            if len(taken) < limit and p not in taken:
                taken[p] = term
    order = files.sparkSession.createDataFrame([(i, p, t) for i, (p, t) in enumerate(taken.items(), 1)], "rank int, path string, term string")
    rows = code.where(F.col("path").isin(list(taken))).join(order, "path").withColumn("lines", F.split("text", "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.contains(F.col("term"))), F.lit(True)).cast("int")
    first = F.greatest(F.col("line") - around, F.lit(1))
    excerpt = F.array_join(F.slice("lines", first, F.col("line") + around - first + 1), "\n")
    score = F.greatest(F.lit(0.1), 1.0 - (F.col("rank") - 1) * 0.1)
    return rows.withColumn("line", at).select("rank", "path", "term", "line", excerpt.alias("excerpt"), F.round(score, 6).alias("score"))


def capped(chunks: DataFrame, ctags: DataFrame, bm25: DataFrame, n: int) -> DataFrame:
    """``(doc, score)`` of the ``n`` chunks to rank on, by 0.65 of the symbol score and 0.35 of BM25, both brought to 0..1;
    ties go to the smaller start line."""
    parts = [K.min_max(s.select("doc", "score")).select("doc", (F.col("score") * w).alias("s")) for s, w in ((ctags, 0.65), (bm25, 0.35))]
    both = parts[0].union(parts[1]).groupBy("doc").agg(F.round(F.sum("s"), 9).alias("score"))
    rows = chunks.select(F.col("chunk_id").alias("doc"), F.coalesce("start_line", F.lit(0)).alias("start")).join(both, "doc", "left").select("doc", "start", F.coalesce("score", F.lit(0.0)).alias("score"))
    return rows.orderBy(F.desc("score"), "start", "doc").limit(n).select("doc", "score")
