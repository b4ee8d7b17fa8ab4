"""Queries for ranking, vectors and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ranking as K
from millrace.operators import relational as J
from millrace.plans.registry import Registry
from millrace.plans.scalars import _TOKENS
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

ASK = "stale cache snapshot worker retry bucket cache"
CODE_ASK = "publish gather function bucket_index archive"
_FIELDS = {"symbol": (4.5, 0.05), "signature": (2.6, 0.2), "path": (1.2, 0.2), "body": (0.45, 0.65)}
_KINDS = {"function": "function def fn method", "async_function": "async function def method", "type": "class type struct interface enum", "code": "code snippet"}
_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _bm25_sql(docs: str, fields: dict[str, tuple[float, float]], query_: str) -> str:
    """BM25 over ``docs(doc, <fields>)``, written as joins of token counts."""
    terms = K._query_tokens(query_)
    values = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    tok = " UNION ALL ".join(f"SELECT doc, '{f}' AS field, unnest({_TOKENS.format(f'coalesce({f}, chr(32))').replace('x -> ', 'lambda x: ')}) AS term FROM d" for f in fields)
    par = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in fields.items())
    return f"""WITH d AS ({docs}), q(term, times) AS (VALUES {values}), par(field, weight, b) AS (VALUES {par}), tok AS ({tok}),
      len AS (SELECT doc, field, count(*) AS dl FROM tok GROUP BY ALL), total AS (SELECT count(*) AS n FROM d),
      av AS (SELECT field, sum(dl) / (SELECT n FROM total) AS avgdl FROM len GROUP BY field),
      tf AS (SELECT doc, field, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
      df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)
      SELECT doc, sum(times * weight * ln(1 + ((SELECT n FROM total) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - b + b * dl / avgdl))) AS score
      FROM tf JOIN df USING (field, term) JOIN q USING (term) JOIN len USING (doc, field) JOIN av USING (field) JOIN par USING (field) GROUP BY doc"""


_TEXT_BM25 = _bm25_sql("SELECT doc_id AS doc, text AS body FROM documents", {"body": (1.0, 0.75)}, ASK)
_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = f"({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')}) / sqrt({_DOT.format('b.embedding', 'b.embedding')}))"


@query(f"""WITH bm AS (SELECT doc, round(score, 9) AS score FROM ({_TEXT_BM25})), br AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM bm QUALIFY rank <= 50),
  ve AS (SELECT a.vec_id AS doc, round({_COS}, 9) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0), vr AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM ve QUALIFY rank <= 50),
  f AS (SELECT doc, 0.17 / (60 + rank) AS s FROM br UNION ALL SELECT doc, 0.33 / (60 + rank) FROM vr)
  SELECT doc, round(sum(s), 9) AS score FROM f GROUP BY doc ORDER BY score DESC, doc LIMIT 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))
    lexical = K.bm25f(docs, ASK, {"body": (1.0, 0.75)}).withColumn("score", F.round("score", 9))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    asked = vectors.where("doc = 0").first()["embedding"]
    semantic = vectors.withColumn("score", F.round(K.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in asked])), 9))
    fused = K.reciprocal_rank_fusion({"bm25": K.top(lexical, 50), "embedding": K.top(semantic.drop("embedding"), 50)})
    return K.top(fused.withColumn("score", F.round("score", 9)), 10).drop("rank")


_CODE_DOCS = "SELECT chunk_id AS doc, any_value(symbol) AS symbol, any_value(signature) AS signature, any_value(file_path) AS path, any_value(content) AS body FROM code_chunk GROUP BY chunk_id"


def _code_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_chunk").select(F.col("chunk_id").alias("doc"), "symbol", "signature", F.col("file_path").alias("path"), F.col("content").alias("body"), "symbol_kind", "ingested_at")
    return J.latest(rows, ["doc"], [F.col("ingested_at")]).drop("ingested_at")


@query(f"SELECT doc, round(score, 6) AS score FROM ({_bm25_sql(_CODE_DOCS, _FIELDS, CODE_ASK)})")
def bm25f(spark: SparkSession, d: str) -> DataFrame:
    return K.bm25f(_code_docs(spark, d), CODE_ASK).select("doc", F.round("score", 6).alias("score"))


def _symbol_sql() -> str:
    terms = list(dict.fromkeys(w for w in K._query_tokens(CODE_ASK) if len(w) > 2))
    parts = []
    for t in terms:
        parts.append(f"CASE WHEN s = '{t}' THEN 3.0 WHEN contains(s, '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(g, '{t}') THEN 1.0 ELSE 0 END + CASE WHEN contains(p, '{t}') THEN 0.6 ELSE 0 END")
    named = [k for k, w in _KINDS.items() if set(w.split()) & set(terms)] or [""]
    kind = "CASE WHEN coalesce(symbol_kind, 'code') IN (" + ", ".join(f"'{k}'" for k in named) + ") THEN 0.8 ELSE 0 END"
    return f"""SELECT doc, CAST(round({' + '.join(parts)} + {kind}, 6) AS DOUBLE) AS score FROM (SELECT chunk_id AS doc, lower(coalesce(any_value(symbol), '')) AS s, lower(coalesce(any_value(signature), '')) AS g,
      lower(any_value(file_path)) AS p, any_value(symbol_kind) AS symbol_kind FROM code_chunk GROUP BY chunk_id)"""


@query(f"SELECT * FROM ({_symbol_sql()}) WHERE score > 0")
def symbol_score(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = K.symbol_score(c("symbol"), c("signature"), c("path"), c("symbol_kind"), CODE_ASK)
    return _code_docs(spark, d).select("doc", F.round(s, 6).alias("score")).where("score > 0")


@query(f"""WITH b AS (SELECT doc, round(score, 6) AS score FROM ({_bm25_sql(_CODE_DOCS, _FIELDS, CODE_ASK)})), br AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM b QUALIFY rank <= 20),
  s AS (SELECT * FROM ({_symbol_sql()}) WHERE score > 0), sr AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 20)
  SELECT doc, round(sum(w), 9) AS score FROM (SELECT doc, 0.17 / (60 + rank) AS w FROM br UNION ALL SELECT doc, 0.17 / (60 + rank) FROM sr) GROUP BY doc""")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    fused = K.reciprocal_rank_fusion({"bm25": K.top(bm25f(spark, d), 20), "ctags": K.top(symbol_score(spark, d), 20)})
    return fused.withColumn("score", F.round("score", 9))


@query("""WITH e AS (SELECT from_uri, to_uri, max(coalesce(weight, 0)) AS score FROM relation_edge GROUP BY ALL), m AS (SELECT from_uri, min(score) AS lo, max(score) AS hi FROM e GROUP BY 1)
  SELECT from_uri, to_uri, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) AS score FROM e JOIN m USING (from_uri)""")
def min_max(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relation_edge").groupBy("from_uri", "to_uri").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("score"))
    return K.min_max(edges, ["from_uri"]).select("from_uri", "to_uri", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT from_uri, to_uri, max(coalesce(weight, 0)) AS score FROM relation_edge GROUP BY ALL),
  r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM e WINDOW w AS (PARTITION BY from_uri ORDER BY score DESC, to_uri)),
  g AS (SELECT *, CASE WHEN rank >= 3 AND next IS NOT NULL AND score > 0 THEN (score - next) / score END AS gap FROM r),
  c AS (SELECT from_uri, max(gap) AS best FROM g GROUP BY 1), l AS (SELECT g.from_uri, min(rank) AS last FROM g JOIN c ON g.from_uri = c.from_uri AND gap = best WHERE best >= 0.15 GROUP BY 1)
  SELECT g.from_uri, to_uri, round(score, 6) AS score, rank FROM g LEFT JOIN l USING (from_uri) WHERE last IS NULL OR rank <= last""")
def score_gap(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relation_edge").groupBy("from_uri", "to_uri").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("score"))
    cut = K.score_gap(edges, "from_uri", [F.desc("score"), F.asc("to_uri")])
    return cut.select("from_uri", "to_uri", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT a.vec_id, a.label, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")
def cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = F.array(*[F.lit(float(x)) for x in vectors.where("vec_id = 0").first()["embedding"]])
    return vectors.select("vec_id", "label", F.round(K.cosine(F.col("embedding"), asked), 6).alias("score"))


@query(f"""WITH s AS (SELECT a.vec_id, a.label, round({_COS}, 9) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.label IN (1, 2, 3))
  SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY s.score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def filtered_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = F.array(*[F.lit(float(x)) for x in vectors.where("vec_id = 0").first()["embedding"]])
    scored = J.matching(vectors, label=[1, 2, 3], unknown=7).select("vec_id", F.round(K.cosine(F.col("embedding"), asked), 9).alias("score"))
    return K.top(scored, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "rank")


_NOW = "TIMESTAMP '2026-01-01'"


@query(f"""WITH b AS (SELECT id, embedding FROM index_record WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 ORDER BY id LIMIT 1),
  r AS (SELECT id, any_value(level) AS level, any_value(embedding) AS embedding, max(active_count) AS active_count, max(updated_at) AS updated_at FROM index_record GROUP BY id),
  s AS (SELECT a.id, CASE WHEN len(a.embedding) = 64 AND list_sum(list_transform(a.embedding, lambda x: x * x)) > 0 THEN {_COS} ELSE 0 END AS semantic,
    coalesce(ln(1 + coalesce(active_count, 0)) / (ln(1 + coalesce(active_count, 0)) + 1) * exp(-ln(2) * greatest(0, (epoch_us({_NOW}) - epoch_us(updated_at)) / 86400000000.0) / 7), 0) AS hot FROM r a, b WHERE a.level = 2)
  SELECT id, round(0.8 * coalesce(semantic, 0) + 0.2 * hot, 6) AS score FROM s""")
def hotness_blend(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    fine = F.expr("embedding IS NOT NULL AND size(embedding) = 64 AND exists(embedding, x -> x <> 0)")
    asked = F.array(*[F.lit(float(x)) for x in records.where(fine).orderBy("id").select("embedding").first()[0]])
    once = records.groupBy("id").agg(F.any_value("level").alias("level"), F.any_value("embedding").alias("embedding"), F.max("active_count").alias("active_count"), F.max("updated_at").alias("updated_at"))
    hot = T.hotness(F.col("active_count"), F.col("updated_at").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    return once.where("level = 2").select("id", F.round(0.8 * K.cosine(F.col("embedding"), asked) + 0.2 * hot, 6).alias("score"))


@query()
def page_rank(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relation_edge").groupBy(F.col("from_uri").alias("src"), F.col("to_uri").alias("dst")).agg(F.max(F.coalesce("weight", F.lit(0.5))).alias("weight"))
    seeds = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("mass"))
    return K.page_rank(edges, seeds).select("node", F.round("rank", 9).alias("rank"))


def _rank_sql() -> str:
    steps = ["""e AS (SELECT from_uri AS src, to_uri AS dst, max(coalesce(weight, 0.5)) AS weight FROM relation_edge GROUP BY ALL), o AS (SELECT src, sum(weight) AS total FROM e GROUP BY 1),
      p AS (SELECT e.src, dst, weight / total AS p FROM e JOIN o USING (src) WHERE total > 0), b AS (SELECT src AS node, total / (SELECT sum(total) FROM o) AS base FROM o), r0 AS MATERIALIZED (SELECT node, base AS rank FROM b)"""]
    for i in range(14):
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node, 0.35 * coalesce(base, 0) + 0.65 * coalesce(m, 0) AS rank FROM b FULL JOIN (SELECT dst AS node, sum(rank * p) AS m FROM p JOIN r{i} ON p.src = r{i}.node GROUP BY 1) USING (node))")
    return "WITH " + ", ".join(steps) + " SELECT node, round(rank, 9) AS rank FROM r14"


SQL["page_rank"] = _rank_sql()

_V = "(SELECT embedding FROM index_record WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 ORDER BY id LIMIT 1)"
_SIM = f"CASE WHEN len(a.embedding) = 64 AND list_sum(list_transform(a.embedding, lambda x: x * x)) > 0 THEN {_COS} ELSE 0 END"


@query(f"""WITH b AS (SELECT {_V} AS embedding), r AS (SELECT id, any_value(uri) AS uri, any_value(level) AS level, any_value(rtrim(parent_uri, '/')) AS parent, any_value(embedding) AS embedding FROM index_record GROUP BY id),
  s AS (SELECT a.id, a.uri, a.level, a.parent, {_SIM} AS own FROM r a, b), t AS (SELECT * FROM s ORDER BY own DESC, id LIMIT 30),
  f AS (SELECT uri, max(own) AS score FROM t WHERE level < 2 GROUP BY 1),
  c AS (SELECT s.uri, CASE WHEN f.score = 0 THEN own ELSE 0.5 * own + 0.5 * f.score END AS score FROM f JOIN s ON s.parent = rtrim(f.uri, '/')),
  u AS (SELECT uri, own AS score FROM t WHERE level = 2 UNION ALL SELECT uri, score FROM c WHERE score > 0)
  SELECT uri, round(max(score), 6) AS score FROM u GROUP BY 1 ORDER BY max(score) DESC, uri LIMIT 10""")
def hierarchical_search(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators import search

    records = table(spark, d, "index_record")
    fine = F.expr("embedding IS NOT NULL AND size(embedding) = 64 AND exists(embedding, x -> x <> 0)")
    vector = records.where(fine).orderBy("id").select("embedding").first()[0]
    return search.hierarchical(records, vector).select("uri", F.round("score", 6).alias("score"))
