"""Queries for joins, merges, deltas, windows and aggregates on records, chunks, edges and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions import text as T
from millrace.operators import relational as J
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

_CUT = "2025-03-20"


@query("""WITH e AS (SELECT from_uri, to_uri, relation_type, max(coalesce(weight, 0)) AS weight FROM relation_edge GROUP BY ALL)
  SELECT from_uri, row_number() OVER (PARTITION BY from_uri ORDER BY weight DESC, to_uri, relation_type) AS rank, to_uri, relation_type, weight FROM e QUALIFY rank <= 3""")
def one_hop(spark: SparkSession, d: str) -> DataFrame:
    return J.top_edges(table(spark, d, "relation_edge"), 3)


@query("""WITH e AS (SELECT from_uri, to_uri, relation_type, coalesce(weight, 0) < 0.5 AS old, max(weight) AS weight FROM relation_edge GROUP BY ALL)
  SELECT from_uri, to_uri, relation_type, weight FROM e QUALIFY row_number() OVER (PARTITION BY from_uri, to_uri, relation_type ORDER BY old) = 1""")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Light edges are there, heavy ones arrive and replace those of the same key."""
    edges, keys = table(spark, d, "relation_edge"), ["from_uri", "to_uri", "relation_type"]
    once = lambda rows: rows.groupBy(*keys).agg(F.max("weight").alias("weight"))
    light = F.coalesce("weight", F.lit(0.0)) < 0.5
    return J.upsert(once(edges.where(light)), once(edges.where(~light)), keys)


@query("""SELECT id, uri, level, active_count, epoch_us(updated_at) AS updated_us FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, active_count DESC NULLS LAST) AS n FROM index_record) WHERE n = 1""")
def record_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_record").select("id", "uri", "level", "active_count", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))
    return J.latest(rows, ["id"], [F.coalesce("updated_us", F.lit(-(1 << 62))), F.coalesce("active_count", F.lit(-1))])


@query("""WITH p AS (SELECT DISTINCT uri FROM index_record WHERE level < 2), c AS (SELECT DISTINCT id, parent_uri, uri FROM index_record WHERE level = 2)
  SELECT p.uri, count(c.id) AS children FROM p LEFT JOIN c ON c.parent_uri = p.uri GROUP BY 1""")
def children(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    kids = records.where("level = 2").select("id", "parent_uri").distinct().groupBy(F.col("parent_uri").alias("uri")).agg(F.count("*").alias("n"))
    return records.where("level < 2").select("uri").distinct().join(kids, "uri", "left").select("uri", F.coalesce("n", F.lit(0)).alias("children"))


@query("""WITH r AS (SELECT DISTINCT repo, chunk_id AS source, k.relation, unnest(k.names) AS name FROM (SELECT repo, chunk_id, unnest([{'relation': 'calls', 'names': graph.calls}, {'relation': 'extends', 'names': graph.extends}, {'relation': 'contains', 'names': graph.contains}]) AS k FROM code_chunk)),
  t AS (SELECT DISTINCT repo, chunk_id AS target, lower(string_split(symbol, '.')[-1]) AS key FROM code_chunk WHERE symbol IS NOT NULL)
  SELECT DISTINCT source, relation, name, target FROM r JOIN t ON r.repo = t.repo AND lower(string_split(name, '.')[-1]) = t.key WHERE source <> target""")
def resolve_symbols(spark: SparkSession, d: str) -> DataFrame:
    return J.resolve_symbols(table(spark, d, "code_chunk"))


_FILES = "SELECT repo, file_path, md5(string_agg(md5(content), ',' ORDER BY start_line, chunk_id)) AS digest FROM (SELECT DISTINCT repo, file_path, start_line, chunk_id, content FROM code_chunk {0}) GROUP BY ALL"


def _files(df: DataFrame) -> DataFrame:
    piece = F.struct("start_line", "chunk_id", F.md5("content").alias("h"))
    return df.groupBy("repo", "file_path").agg(F.md5(F.array_join(F.array_sort(F.collect_set(piece))["h"], ",")).alias("digest"))


@query(f"""WITH o AS ({_FILES.format(f"WHERE ingested_at < TIMESTAMP '{_CUT}'")}), n AS ({_FILES.format("WHERE symbol_kind IS DISTINCT FROM 'type'")})
  SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.digest IS NULL THEN 'A' WHEN n.digest IS NULL THEN 'D' ELSE 'M' END AS change
  FROM o FULL JOIN n ON o.repo = n.repo AND o.file_path = n.file_path WHERE o.digest IS DISTINCT FROM n.digest""")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "code_chunk")
    return J.snapshot_diff(_files(chunks.where(F.col("ingested_at") < F.lit(_CUT).cast("timestamp_ntz"))), _files(chunks.where(~F.col("symbol_kind").eqNullSafe("type"))), ["repo", "file_path"], "digest")


@query("""WITH h AS (SELECT chunk_id, any_value(lower(chunk_hash)) AS stored, any_value(sha256(content)) AS actual FROM code_chunk GROUP BY 1)
  SELECT chunk_id, stored IS NOT NULL AND stored = actual AS same FROM h WHERE stored IS NULL OR stored <> actual""")
def hash_delta(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunk").groupBy("chunk_id").agg(F.any_value(F.lower("chunk_hash")).alias("stored"), F.any_value(F.sha2("content", 256)).alias("actual"))
    return c.where("stored IS NULL OR stored <> actual").select("chunk_id", (F.col("stored").isNotNull() & (F.col("stored") == F.col("actual"))).alias("same"))


@query("""SELECT account_id, rtrim(owner_space, '/') AS owner_space, count(DISTINCT id) AS records FROM index_record GROUP BY ALL""")
def tenant_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_record").groupBy("account_id", F.regexp_replace("owner_space", "/+$", "").alias("owner_space")).agg(F.count_distinct("id").alias("records"))


@query("""SELECT id, account_id FROM index_record WHERE account_id <> (SELECT account_id FROM index_record GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def delete_account(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "index_record")
    gone = records.groupBy("account_id").count().orderBy(F.desc("count"), "account_id").limit(1)
    return records.select("id", "account_id").join(gone.select("account_id"), "account_id", "left_anti").select("id", "account_id")


@query("""WITH s AS (SELECT DISTINCT parent_uri, uri, substr(text, 1, 200) AS abstract FROM index_record WHERE parent_uri IS NOT NULL AND trim(text) <> ''),
  n AS (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY uri, abstract) AS n FROM s) SELECT parent_uri, uri, abstract FROM n WHERE n <= 20""")
def sibling_abstracts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "index_record").where("parent_uri IS NOT NULL AND trim(text) <> ''").select("parent_uri", "uri", F.substring("text", 1, 200).alias("abstract")).distinct()
    return s.withColumn("n", F.row_number().over(W.partitionBy("parent_uri").orderBy("uri", "abstract"))).where("n <= 20").drop("n")


@query("""WITH o AS (SELECT account_id, doc_id, length(text) // 4 AS t, row_number() OVER w AS n, sum(length(text) // 4) OVER w AS used FROM documents WINDOW w AS (PARTITION BY account_id ORDER BY created_at DESC NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT account_id, min(n) AS stop FROM o WHERE n > 1 AND used > 2000 GROUP BY 1)
  SELECT account_id, doc_id, t AS tokens, n AS position FROM o LEFT JOIN c USING (account_id) WHERE n = 1 OR stop IS NULL OR n < stop""")
def archive_budget(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("account_id").orderBy(F.desc_nulls_last("created_at"), "doc_id")
    docs = table(spark, d, "documents").select("account_id", "doc_id", "created_at", F.floor(F.length("text") / 4).alias("tokens"))
    run = docs.withColumn("position", F.row_number().over(w)).withColumn("used", F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    over = F.max(((F.col("position") > 1) & (F.col("used") > 2000)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return run.withColumn("over", over).where("over = 0").select("account_id", "doc_id", "tokens", "position")


@query("""WITH n AS (SELECT account_id, text, created_at, doc_id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS n FROM documents)
  SELECT account_id, md5(string_agg(text, chr(10) ORDER BY n DESC)) AS digest, count(*) AS texts FROM n WHERE n <= 3 GROUP BY 1""")
def last_three(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("account_id").orderBy(F.desc_nulls_last("created_at"), F.desc("doc_id")))
    last = table(spark, d, "documents").select("account_id", "text", "created_at", "doc_id").withColumn("n", n).where("n <= 3")
    item = F.struct((-F.col("n")).alias("k"), "text")
    return last.groupBy("account_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(item))["text"], "\n")).alias("digest"), F.count("*").alias("texts"))


@query("""SELECT repo, file_path, last(symbol ORDER BY start_line, chunk_id) FILTER (symbol IS NOT NULL) AS symbol, max(end_line) AS end_line, count(DISTINCT chunk_id) AS chunks FROM code_chunk GROUP BY ALL""")
def last_known(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("symbol").isNotNull(), F.struct("start_line", "chunk_id"))
    return table(spark, d, "code_chunk").groupBy("repo", "file_path").agg(F.max_by("symbol", key).alias("symbol"), F.max("end_line").alias("end_line"), F.count_distinct("chunk_id").alias("chunks"))


@query("""SELECT source, count(*) AS texts, sum(greatest(1, length(text) // 4)) AS tokens, sum(greatest(0, greatest(1, length(text) // 4) - greatest(1, least(length(text), 500) // 4))) AS saved FROM documents GROUP BY 1""")
def savings(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    full, cut = T.quarter_tokens(t), T.quarter_tokens(F.substring(t, 1, 500))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.sum(full).alias("tokens"), F.sum(F.greatest(F.lit(0), full - cut)).alias("saved"))


@query("""SELECT sha256(text) AS digest, min(doc_id) AS doc_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS copies FROM documents GROUP BY 1""")
def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("copies"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), r AS (SELECT doc_id, regexp_extract(l, '^(user|assistant|tool|system): ', 1) AS role, l FROM l)
  SELECT doc_id, role, count(*) AS turns, sum(length(l)) AS chars FROM r WHERE role <> '' GROUP BY ALL""")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return l.select("doc_id", F.regexp_extract("l", "^(user|assistant|tool|system): ", 1).alias("role"), F.length("l").alias("n")).where("role <> ''").groupBy("doc_id", "role").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))


@query("""WITH c AS (SELECT coalesce(parent_uri, '') AS parent_uri, coalesce(category, 'unknown') AS category, count(DISTINCT id) AS n FROM index_record GROUP BY ALL)
  SELECT parent_uri, 'Contains ' || string_agg(n || ' ' || category, ', ' ORDER BY category) AS abstract FROM c GROUP BY 1""")
def directory_abstract(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "index_record").groupBy(F.coalesce("parent_uri", F.lit("")).alias("parent_uri"), F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count_distinct("id").alias("n"))
    item = F.struct("category", F.concat_ws(" ", F.col("n").cast("string"), "category").alias("t"))
    return c.groupBy("parent_uri").agg(F.concat(F.lit("Contains "), F.array_join(F.array_sort(F.collect_list(item))["t"], ", ")).alias("abstract"))


@query("""WITH f AS (SELECT uri, max(has_overview) AS o, max(has_content) AS c, count(DISTINCT level) AS levels FROM index_record WHERE level < 2 GROUP BY 1)
  SELECT CASE WHEN o AND c AND levels = 2 THEN 'activate' WHEN c THEN 'pending' ELSE 'skip' END AS action, count(*) AS nodes FROM f GROUP BY 1""")
def repair_summary(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "index_record").where("level < 2").groupBy("uri").agg(F.max("has_overview").alias("o"), F.max("has_content").alias("c"), F.count_distinct("level").alias("levels"))
    return f.groupBy(F.when(F.col("o") & F.col("c") & (F.col("levels") == 2), "activate").when(F.col("c"), "pending").otherwise("skip").alias("action")).agg(F.count("*").alias("nodes"))


@query("""SELECT e.from_uri, e.to_uri, e.relation_type FROM (SELECT DISTINCT from_uri, to_uri, relation_type FROM relation_edge) e WHERE NOT EXISTS (SELECT 1 FROM index_record r WHERE r.uri = e.to_uri)""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "relation_edge").select("from_uri", "to_uri", "relation_type").distinct()
    return edges.join(table(spark, d, "index_record").select(F.col("uri").alias("to_uri")), "to_uri", "left_anti").select("from_uri", "to_uri", "relation_type")


@query("""WITH t AS (SELECT uri, max(CASE WHEN level = 0 THEN text END) AS abstract, max(CASE WHEN level = 1 THEN text END) AS overview, NULL AS content FROM index_record WHERE level < 2 GROUP BY 1)
  SELECT uri, level, text, record_uri FROM (SELECT uri, 0 AS level, abstract AS text, uri AS record_uri FROM t UNION ALL SELECT uri, 1, overview, uri FROM t) WHERE trim(text) <> ''""")
def node_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "index_record").where("level < 2").groupBy("uri").agg(
        F.max(F.when(F.col("level") == 0, F.col("text"))).alias("abstract"), F.max(F.when(F.col("level") == 1, F.col("text"))).alias("overview"), F.lit(None).cast("string").alias("content")
    )
    return J.levels(nodes)


@query("""WITH m AS (SELECT doc_id, regexp_extract(line, '^([\\w./-]+):(\\d+):', 1) AS path, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  SELECT doc_id, path, count(*) AS matches, min(i) AS first_line FROM m WHERE path <> '' GROUP BY ALL""")
def match_groups(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    m = l.select("doc_id", F.regexp_extract("line", r"^([\w./-]+):(\d+):", 1).alias("path"), (F.col("i") + 1).alias("i")).where("path <> ''")
    return m.groupBy("doc_id", "path").agg(F.count("*").alias("matches"), F.min("i").alias("first_line"))


@query("""SELECT doc_id, i AS line, l AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '(?i)not (closed|found|reached)')""")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))
    return l.where(F.col("content").rlike("(?i)not (closed|found|reached)")).select("doc_id", (F.col("i") + 1).alias("line"), "content")


@query("""SELECT o_orderpriority, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def sql_passthrough(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources.sql import run

    return run(spark, d, ["orders", "lineitem"], SQL["sql_passthrough"].replace("TIMESTAMP '1995-01-01'", "TIMESTAMP_NTZ '1995-01-01'"))
