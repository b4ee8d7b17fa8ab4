"""Queries for access, seeds, assembled answers and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import assembly as A
from millrace.operators import relational as J
from millrace.plans.registry import Registry
from millrace.plans.retrieval import _COS
from millrace.sources import stores
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL


def _scope(records: DataFrame) -> A.Scope:
    """The account with the most rows, its first user and agent by name."""
    account = records.groupBy("account_id").count().orderBy(F.desc("count"), "account_id").first()[0]
    inside = records.where(F.col("account_id") == account)
    name = lambda part: inside.select(F.min(F.nullif(F.regexp_extract("uri", rf"^ctx://[^/]+/{part}/([^/]+)/", 1), F.lit("")))).first()[0] or ""
    return A.Scope(account, name("users"), name("agents"))


_WHO = """a AS (SELECT account_id AS account FROM index_record GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  s AS (SELECT account, (SELECT coalesce(min(nullif(regexp_extract(uri, '^ctx://[^/]+/users/([^/]+)/', 1), '')), '') FROM index_record WHERE account_id = account) AS u,
    (SELECT coalesce(min(nullif(regexp_extract(uri, '^ctx://[^/]+/agents/([^/]+)/', 1), '')), '') FROM index_record WHERE account_id = account) AS g FROM a)"""


@query(f"""WITH {_WHO}, p AS (SELECT DISTINCT uri, regexp_extract(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$', 1) AS acc, regexp_extract(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$', 2) AS sc,
    regexp_extract(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$', 3) AS ow FROM index_record)
  SELECT uri, acc = account AND (ow = '' OR sc = 'resources' OR (sc = 'users' AND ow = u) OR (sc = 'agents' AND ow = g)) AS accessible,
    starts_with(uri, 'ctx://' || account || '/') AND NOT (starts_with(uri, 'ctx://' || account || '/users/') AND NOT starts_with(uri, 'ctx://' || account || '/users/' || u || '/'))
      AND NOT (g <> '' AND starts_with(uri, 'ctx://' || account || '/agents/') AND NOT starts_with(uri, 'ctx://' || account || '/agents/' || g || '/')) AS readable FROM p, s""")
def access(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    scope, u = _scope(records), F.col("uri")
    return records.select("uri").distinct().select("uri", A.accessible(u, scope).alias("accessible"), A.readable(u, scope).alias("readable"))


_VEC = "(SELECT embedding FROM index_record WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 ORDER BY id LIMIT 1)"
_SEEDS = f"""{_WHO}, v AS (SELECT {_VEC} AS embedding), r AS (SELECT * FROM index_record, s WHERE account_id = account QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, active_count DESC NULLS LAST) = 1),
  c AS (SELECT a.id, a.uri, a.level, coalesce(a.category, '') AS category, coalesce(a.owner_space, '') AS owner_space, substr(coalesce(a.text, ''), 1, 200) AS abstract,
    round(CASE WHEN len(a.embedding) = 64 AND list_sum(list_transform(a.embedding, lambda x: x * x)) > 0 THEN {_COS} ELSE 0 END, 9) AS score FROM r a, v b)"""


def _seeds(spark: SparkSession, d: str, n: int) -> DataFrame:
    records = table(spark, d, "index_record")
    fine = F.expr("embedding IS NOT NULL AND size(embedding) = 64 AND exists(embedding, x -> x <> 0)")
    vector = records.where(fine).orderBy("id").select("embedding").first()[0]
    return A.vector_seeds(records, vector, _scope(records), n=n)


@query(f"WITH {_SEEDS} SELECT id, uri, level, category, abstract, round(score, 6) AS score, row_number() OVER (ORDER BY c.score DESC, id) AS rank FROM c QUALIFY rank <= 30")
def vector_seeds(spark: SparkSession, d: str) -> DataFrame:
    return _seeds(spark, d, 30).select("id", "uri", "level", "category", "abstract", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_SEEDS}, t AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 60), b AS (SELECT uri, max(score) AS score, arg_max(category, (score, abstract)) AS category FROM t WHERE level = 2 GROUP BY 1),
  p AS (SELECT *, row_number() OVER (ORDER BY b.score DESC, uri) AS position FROM b QUALIFY position <= 10), x AS (SELECT uri, min(text) AS content FROM index_record WHERE level = 2 GROUP BY 1),
  e AS (SELECT from_uri, to_uri, relation_type, max(coalesce(weight, 0)) AS w FROM relation_edge GROUP BY ALL), k AS (SELECT from_uri, to_uri, row_number() OVER (PARTITION BY from_uri ORDER BY w DESC, to_uri, relation_type) AS n FROM e QUALIFY n <= 3),
  h AS (SELECT from_uri, string_agg(to_uri, ' ' ORDER BY n) AS relations FROM k GROUP BY 1)
  SELECT position, p.uri, round(score, 6) AS score, category, CASE WHEN position <= 3 THEN md5(content) END AS content, coalesce(relations, '') AS relations FROM p LEFT JOIN x ON x.uri = p.uri LEFT JOIN h ON h.from_uri = p.uri""")
def assembled(spark: SparkSession, d: str) -> DataFrame:
    contents = table(spark, d, "index_record").where("level = 2").select("uri", F.col("text").alias("content"))
    a = A.assembled(_seeds(spark, d, 60), 10, contents=contents, filled=3, edges=table(spark, d, "relation_edge"))
    return a.select("position", "uri", F.round("score", 6).alias("score"), "category", F.md5("content").alias("content"), F.array_join("relations", " ").alias("relations"))


@query(f"""WITH {_SEEDS}, l AS (SELECT uri, 0 AS query, row_number() OVER (ORDER BY score DESC, id) AS rank FROM c QUALIFY rank <= 20), m AS (SELECT uri, 1 AS query, row_number() OVER (ORDER BY score, id) AS rank FROM c QUALIFY rank <= 20)
  SELECT uri, query, rank FROM (FROM l UNION ALL FROM m) QUALIFY row_number() OVER (PARTITION BY uri ORDER BY query, rank) = 1""")
def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two lists, the most and the least similar, one behind the other."""
    every = _seeds(spark, d, 1 << 30).select("id", "uri", "score")
    from millrace.operators.ranking import top

    one, two = top(every, 20, "id"), top(every.withColumn("score", -F.col("score")), 20, "id")
    return A.first_seen([one.select("uri", "rank"), two.select("uri", "rank")]).select("uri", "query", "rank")


@query("SELECT DISTINCT repo || '/' || file_path AS path FROM code_chunk WHERE NOT starts_with(repo || '/' || file_path, 'harborline/ctxcore/')")
def tree_deleted(spark: SparkSession, d: str) -> DataFrame:
    return stores.without_tree(table(spark, d, "code_chunk").select(F.concat_ws("/", "repo", "file_path").alias("path")).distinct(), "harborline/ctxcore/")


@query("SELECT string_split(file_path, '/')[-1] AS name, octet_length(encode(content)) AS size FROM code_chunk WHERE content IS NOT NULL")
def key_listing(spark: SparkSession, d: str) -> DataFrame:
    return stores.key_listing(table(spark, d, "code_chunk").where("content IS NOT NULL").select(F.col("file_path").alias("key"), F.col("content").alias("value")))


@query("""SELECT folder, md5(overview) AS overview, md5(abstract) AS abstract FROM (SELECT uri AS folder, max(CASE WHEN level = 0 THEN text END) AS abstract, max(CASE WHEN level = 1 THEN text END) AS overview, max(has_content) AS ok FROM index_record WHERE level < 2 GROUP BY 1) WHERE ok""")
def node_folders(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "index_record").where("level < 2")
    name = F.when(F.col("level") == 0, ".abstract.md").otherwise(".overview.md")
    files = r.select(F.concat("uri", F.lit("/"), name).alias("path"), "text").union(r.groupBy("uri").agg(F.max("has_content").alias("ok")).where("ok").select(F.concat("uri", F.lit("/.meta.json")), F.lit('{"status": "ACTIVE"}')))
    return stores.nodes_of(files).select("folder", F.md5("overview").alias("overview"), F.md5("abstract").alias("abstract"))


@query("""SELECT id, account_id, rtrim(owner_space, '/') AS owner_space FROM index_record WHERE NOT (account_id = (SELECT min(account_id) FROM index_record)
  AND rtrim(owner_space, '/') = (SELECT min(rtrim(owner_space, '/')) FROM index_record WHERE account_id = (SELECT min(account_id) FROM index_record)))""")
def owner_deleted(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    account = records.agg(F.min("account_id")).first()[0]
    owner = J.scoped(records, account).agg(F.min(F.regexp_replace("owner_space", "/+$", ""))).first()[0]
    return J.without_owner(records, account, owner).select("id", "account_id", F.regexp_replace("owner_space", "/+$", "").alias("owner_space"))


@query("SELECT id, uri FROM index_record WHERE id NOT IN (SELECT id FROM index_record WHERE level = 0)")
def ids_deleted(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    return J.without_ids(records, records.where("level = 0").select("id")).select("id", "uri")
