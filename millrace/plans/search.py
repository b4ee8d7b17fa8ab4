"""Queries for code search end to end. Their SQL has literals of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import code_search as C
from millrace.operators import ranking as K
from millrace.operators.relational import latest
from millrace.plans.registry import Registry
from millrace.plans.retrieval import _CODE_DOCS, _FIELDS, CODE_ASK, _bm25_sql, _symbol_sql
from millrace.sources import chunker
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once: the delivery that came last."""
    rows = table(spark, d, "code_chunk").select("chunk_id", "repo", "symbol", "signature", "file_path", "content", "symbol_kind", "start_line", "graph", "ingested_at")
    return latest(rows, ["chunk_id"], [F.col("ingested_at")]).drop("ingested_at")


def _docs(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("doc"), "symbol", "signature", F.col("file_path").alias("path"), F.col("content").alias("body"), "symbol_kind")


_TERMS = ["publish", "gather", "bucket_index", "archive"]
_HELD = "(" + " + ".join(f"CAST(contains({{0}}, '{t}') AS INT)" for t in _TERMS) + ")"
_IN = ", ".join(f"'{t}'" for t in _TERMS)
_GRAPH_SQL = f"""c AS (SELECT chunk_id, any_value(repo) AS repo, any_value(symbol) AS symbol, any_value(signature) AS signature, any_value(file_path) AS file_path, any_value(content) AS content, any_value(graph) AS graph FROM code_chunk GROUP BY 1),
  nm AS (SELECT DISTINCT repo, chunk_id AS source, unnest(list_concat(list_concat(coalesce(graph.calls, []), coalesce(graph.extends, [])), coalesce(graph.contains, []))) AS name FROM c),
  l AS (SELECT DISTINCT source AS src, t.chunk_id AS dst FROM nm JOIN (SELECT DISTINCT repo, chunk_id, lower(string_split(symbol, '.')[-1]) AS key FROM c WHERE symbol IS NOT NULL) t ON nm.repo = t.repo AND lower(string_split(name, '.')[-1]) = t.key WHERE source <> t.chunk_id),
  dg AS (SELECT n, count(*) AS k FROM (SELECT src AS n FROM l UNION ALL SELECT dst FROM l) GROUP BY 1),
  w AS (SELECT chunk_id, CASE WHEN trim(lower(coalesce(symbol, ''))) IN ({_IN}) THEN 6.0 ELSE 0.0 END + 2.5 * {_HELD.format("lower(coalesce(symbol, ''))")} + 1.8 * {_HELD.format("lower(coalesce(signature, ''))")} + 1.4 * {_HELD.format("lower(file_path)")} AS anchor,
    1.6 * {_HELD.format("lower(array_to_string(list_concat(list_concat(list_concat(coalesce(graph.calls, []), coalesce(graph.imports, [])), coalesce(graph.extends, [])), coalesce(graph.contains, [])), ' '))")} AS named,
    0.75 * {_HELD.format("lower(concat_ws(' ', file_path, coalesce(symbol, ''), coalesce(signature, ''), coalesce(content, '')))")} AS held FROM c),
  a AS MATERIALIZED (SELECT chunk_id AS doc, round(greatest(anchor, held, CASE WHEN named + least(coalesce(k, 0), 4) * 0.25 > 0 THEN anchor + 0.25 * (named + least(coalesce(k, 0), 4) * 0.25) ELSE 0 END), 12)::DOUBLE AS score FROM w LEFT JOIN dg ON n = chunk_id),
  s AS MATERIALIZED (SELECT * FROM a WHERE score > 0),
  hop AS (SELECT doc, round(max(score), 12) AS score FROM (SELECT * FROM s UNION ALL SELECT dst, score * 0.7 * 0.95 FROM l JOIN s ON src = doc UNION ALL SELECT src, score * 0.7 * 0.72 * 0.72 FROM l JOIN s ON dst = doc) GROUP BY 1),
  mm AS (SELECT doc, CASE WHEN (SELECT max(score) FROM s) > (SELECT min(score) FROM s) THEN (score - (SELECT min(score) FROM s)) / ((SELECT max(score) FROM s) - (SELECT min(score) FROM s)) ELSE 1 END AS m FROM s),
  b AS MATERIALIZED (SELECT doc AS node, m / (SELECT sum(m) FROM mm) AS base FROM mm), od AS (SELECT src, count(*) AS k FROM l GROUP BY 1), r0 AS MATERIALIZED (SELECT node, base AS rank FROM b), """ + ", ".join(
    f"r{i + 1} AS MATERIALIZED (SELECT node, 0.35 * coalesce(base, 0) + 0.65 * coalesce(m, 0) AS rank FROM b FULL JOIN (SELECT dst AS node, sum(rank / k) AS m FROM l JOIN od USING (src) JOIN r{i} ON l.src = r{i}.node GROUP BY 1) USING (node))" for i in range(14)
) + """,
  lists AS (SELECT 1 AS i, doc, score FROM s UNION ALL SELECT 2, doc, score FROM hop UNION ALL SELECT 3, node, round(rank, 12) FROM r14 WHERE round(rank, 12) > 0),
  gr AS (SELECT doc, round(sum(1.0 / (60 + n)), 9)::DOUBLE AS score FROM (SELECT doc, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc) AS n FROM lists) GROUP BY 1)"""


@query(f"WITH {_GRAPH_SQL} SELECT doc, score FROM gr")
def graph_rank(spark: SparkSession, d: str) -> DataFrame:
    return C.graph_rank(_chunks(spark, d), CODE_ASK).select("doc", F.round("score", 9).alias("score"))


_BYTES = "list_transform(range(32), lambda i: (CAST('0x' || substr({0}, 2 * i + 1, 2) AS INT) - 128) / 128.0)"
_EMBED_SQL = f"""ev AS (SELECT chunk_id AS doc, {_BYTES.format("sha256(any_value(content))")} AS v FROM code_chunk GROUP BY 1), eq AS (SELECT {_BYTES.format(f"sha256('{CODE_ASK}')")} AS q),
  em AS (SELECT doc, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(q, q)), 9)::DOUBLE AS score FROM ev, eq)"""


@query(f"""WITH {_GRAPH_SQL}, {_EMBED_SQL}, bm AS (SELECT doc, round(score, 9) AS score FROM ({_bm25_sql(_CODE_DOCS, _FIELDS, CODE_ASK)})), sy AS (SELECT * FROM ({_symbol_sql()}) WHERE score > 0),
  al AS (SELECT 0 AS route, 0.33 AS w, doc, score FROM em UNION ALL SELECT 1, 0.17, doc, score FROM bm UNION ALL SELECT 2, 0.17, doc, score FROM sy UNION ALL SELECT 3, 0.33, doc, score FROM gr),
  rk AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, doc) AS n FROM al), fu AS (SELECT doc, round(sum(w / (60 + n)), 9)::DOUBLE AS score FROM rk WHERE n <= 5 GROUP BY 1),
  re AS (SELECT doc, min(route::BIGINT * 1000000000 + n) AS pl FROM rk WHERE doc NOT IN (SELECT doc FROM fu) GROUP BY 1),
  un AS (SELECT false AS filled, -score AS k1, 0 AS k2, doc, score FROM fu UNION ALL SELECT true, pl, 0, doc, 0 FROM re)
  SELECT row_number() OVER (ORDER BY filled, k1, doc) AS position, doc, score, filled FROM un QUALIFY position <= 30""")
def code_search_routes(spark: SparkSession, d: str) -> DataFrame:
    """Four routes (the embedding is the stand-in of ``hash_vector``), the best five of each fused, topped up to 30."""
    chunks = _chunks(spark, d)
    docs = _docs(chunks)
    asked = T.hash_vector(F.lit(CODE_ASK), 32)
    near = docs.select("doc", F.round(K.cosine(T.hash_vector(F.col("body"), 32), asked), 9).alias("score"))
    lexical = K.bm25f(docs, CODE_ASK).select("doc", F.round("score", 9).alias("score"))
    named = docs.select("doc", F.round(K.symbol_score(F.col("symbol"), F.col("signature"), F.col("path"), F.col("symbol_kind"), CODE_ASK), 6).alias("score")).where("score > 0")
    linked = C.graph_rank(chunks, CODE_ASK).select("doc", F.round("score", 9).alias("score"))
    return C.fused_with_top_up({"embedding": near, "bm25": lexical, "ctags": named, "graph": linked}, 30)


@query(f"""WITH b AS (SELECT doc, score FROM ({_bm25_sql(_CODE_DOCS, _FIELDS, CODE_ASK)})), s AS (SELECT * FROM ({_symbol_sql()}) WHERE score > 0),
  n AS (SELECT doc, 0.35 * CASE WHEN (SELECT max(score) > min(score) FROM b) THEN (score - (SELECT min(score) FROM b)) / (SELECT max(score) - min(score) FROM b) ELSE 1 END AS v FROM b
    UNION ALL SELECT doc, 0.65 * CASE WHEN (SELECT max(score) > min(score) FROM s) THEN (score - (SELECT min(score) FROM s)) / (SELECT max(score) - min(score) FROM s) ELSE 1 END FROM s),
  t AS (SELECT doc, round(sum(v), 9)::DOUBLE AS score FROM n GROUP BY 1), c AS (SELECT chunk_id AS doc, coalesce(any_value(start_line), 0) AS start FROM code_chunk GROUP BY 1)
  SELECT doc, round(score, 6) AS score FROM (SELECT doc, start, coalesce(t.score, 0) AS score FROM c LEFT JOIN t USING (doc)) ORDER BY score DESC, start, doc LIMIT 50""")
def capped_snippets(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    docs = _docs(chunks)
    named = docs.select("doc", F.round(K.symbol_score(F.col("symbol"), F.col("signature"), F.col("path"), F.col("symbol_kind"), CODE_ASK), 6).alias("score")).where("score > 0")
    return C.capped(chunks, named, K.bm25f(docs, CODE_ASK), 50).select("doc", F.round("score", 6).alias("score"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return chunker.files(table(spark, d, "code_chunk")).select(F.concat_ws("/", "repo", "file_path").alias("path"), F.col("source").alias("text"))


_FILES_SQL = """c AS (SELECT repo, file_path, chunk_id, any_value(start_line) AS s, any_value(content) AS t FROM code_chunk GROUP BY ALL), f0 AS (SELECT repo || '/' || file_path AS path, string_agg(t, chr(10) ORDER BY s, chunk_id) AS text FROM c GROUP BY repo, file_path),
  f AS (SELECT * FROM f0 WHERE regexp_matches(path, '(?i)[^/]\\.(py|tsx?|jsx?|go|rs|java|c|cc|cpp|cxx|h|hpp)$')
    AND NOT regexp_matches(path, '(^|/)(\\.git|\\.hg|\\.svn|__pycache__|\\.pytest_cache|\\.mypy_cache|\\.ruff_cache|\\.venv|venv|env|node_modules|dist|build|coverage|\\.next|\\.turbo|\\.cache[^/]*|\\.\\.)(/|$)'))"""
_CAND_SQL = f"""{_FILES_SQL}, g AS (SELECT path FROM f WHERE regexp_matches(path, '^([^/]+/)*[^/]*queue[^/]*\\.py$') ORDER BY path LIMIT 20),
  t1 AS (SELECT path FROM f WHERE contains(text, 'snapshot') AND path NOT IN (FROM g) ORDER BY path LIMIT 60), t2 AS (SELECT path FROM f WHERE contains(text, 'retry') AND path NOT IN (FROM g) AND path NOT IN (FROM t1) ORDER BY path LIMIT 60),
  u AS (SELECT path, 0 AS k FROM g UNION ALL SELECT path, 1 FROM t1 WHERE (SELECT count(*) FROM g) < 20 UNION ALL SELECT path, 2 FROM t2 WHERE (SELECT count(*) FROM g) < 20), cand AS (SELECT path, row_number() OVER (ORDER BY k, path) AS place FROM u QUALIFY place <= 80)"""


@query(f"""WITH {_CAND_SQL}, p AS (SELECT cand.path, place, lower(cand.path) AS lp, lower(text) AS lt FROM cand JOIN f ON f.path = cand.path),
  q AS (SELECT path, place, CASE WHEN contains(lp, 'snapshot') THEN 20 ELSE 0 END + CASE WHEN contains(lp, 'retry') THEN 20 ELSE 0 END AS ip, CASE WHEN regexp_matches(lp, '(snapshot|retry)[^/]*$') THEN 10 ELSE 0 END AS nm,
    5 * least(5, (length(lt) - length(replace(lt, 'snapshot', ''))) // 8) + 5 * least(5, (length(lt) - length(replace(lt, 'retry', ''))) // 5) AS it FROM p)
  SELECT path, ip + nm + it AS score FROM q ORDER BY ip + nm + it DESC, ip DESC, it DESC, place LIMIT 20""")
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    found = C.candidate_files(files, "snapshot retry", globs=["**/*queue*.py"], limit=20)
    return C.file_score(files, found, "snapshot retry", globs=["**/*queue*.py"], limit=20)


@query(f"""WITH {_FILES_SQL}, t1 AS (SELECT path, 'snapshot' AS term FROM f WHERE contains(text, 'snapshot') ORDER BY path LIMIT 5), t2 AS (SELECT path, 'retry' AS term FROM f WHERE contains(text, 'retry') AND path NOT IN (SELECT path FROM t1) ORDER BY path LIMIT 5),
  o AS (SELECT row_number() OVER (ORDER BY term = 'retry', path) AS rank, * FROM (FROM t1 UNION ALL FROM t2) QUALIFY rank <= 5),
  x AS (SELECT rank, o.path, term, string_split(text, chr(10)) AS l FROM o JOIN f ON f.path = o.path), y AS (SELECT *, list_position(list_transform(l, lambda r: contains(r, term)), true) AS line FROM x)
  SELECT rank, path, term, line, array_to_string(l[greatest(1, line - 2):line + 2], chr(10)) AS excerpt, greatest(0.1, 1 - (rank - 1) * 0.1)::DOUBLE AS score FROM y""")
def context_hits(spark: SparkSession, d: str) -> DataFrame:
    return C.context_hits(_files(spark, d), "snapshot retry")
