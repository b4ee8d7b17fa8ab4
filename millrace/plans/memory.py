"""Queries for write planning, budgets, retries, sessions, path tables and condensing of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.functions import shorten as S
from millrace.functions import text as T
from millrace.operators import memory as M
from millrace.plans.registry import Registry
from millrace.plans.scalars import _LINES
from millrace.sources import chunker
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

_CUT = "2025-03-20"
_NEW = f"SELECT repo, file_path, max(md5(content)) AS h FROM code_chunk WHERE ingested_at >= TIMESTAMP '{_CUT}' GROUP BY ALL"
_OLD = f"SELECT repo, file_path, max(md5(content)) AS h FROM code_chunk WHERE ingested_at < TIMESTAMP '{_CUT}' GROUP BY ALL"


@query(f"""WITH n AS ({_NEW}), o AS ({_OLD}) SELECT n.repo, n.file_path, CASE WHEN o.repo IS NULL THEN 'create' WHEN o.h = n.h THEN 'skip' ELSE 'merge' END AS action FROM n LEFT JOIN o ON n.repo = o.repo AND n.file_path = o.file_path""")
def plan_writes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunk").select("repo", "file_path", F.md5("content").alias("h"), (F.col("ingested_at") < F.lit(_CUT).cast("timestamp_ntz")).alias("early"))
    new = c.where("NOT early").groupBy("repo", "file_path").agg(F.max("h").alias("h"))
    return M.plan_writes(new, c.where("early").select("repo", "file_path", "h"), ["repo", "file_path"], "h")


@query("""SELECT id, sha256(uri || ':' || CASE WHEN active_count > 3 THEN 'merge' ELSE 'create' END || ':' || account_id || ':' || md5(text)) AS write_key,
  md5(CASE WHEN trim(coalesce(category, '')) = '' THEN text WHEN trim(text) = '' THEN category ELSE category || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text END) AS merged FROM index_record""")
def write_keys(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "index_record")
    action = F.when(F.col("active_count") > 3, "merge").otherwise("create")
    return r.select("id", M.write_key(F.col("uri"), action, F.col("account_id"), F.md5("text")).alias("write_key"), F.md5(M.merged_text(F.col("category"), F.col("text"))).alias("merged"))


@query("""WITH t AS (SELECT doc_id, length(text) * 30 AS t FROM documents), a AS (SELECT doc_id, t, least(500, t) AS i, least(1000, t - least(500, t)) AS s FROM t), b AS (SELECT *, t - i - s AS r FROM a),
  c AS (SELECT doc_id, i + least(5000 - i, r) AS i, s, r - least(5000 - i, r) AS r FROM b), e AS (SELECT doc_id, i, s + least(10000 - s, r) AS s, r - least(10000 - s, r) AS r FROM c)
  SELECT doc_id, i AS identity, s AS session_state, least(40000, r) AS archive, r - least(40000, r) AS working_set FROM e""")
def budget(spark: SparkSession, d: str) -> DataFrame:
    parts = M.allocate(F.length("text") * 30)
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in parts.items()])


@query("""WITH q AS (SELECT id, lower(trim(status)) = 'processing' AND id % 3 = 0 AS ok, batch_no % 9 AS n FROM queue_messages)
  SELECT id, CASE WHEN ok THEN 'done' WHEN n >= 5 THEN 'dead' ELSE 'retry' END AS outcome, CASE WHEN NOT ok AND n < 5 THEN 5000 + CAST(least(60000, 1000 * pow(2, n)) AS BIGINT) END AS next_ms FROM q""")
def retry_decision(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.lower(F.trim("status")) == "processing") & (F.col("id") % 3 == 0)
    return table(spark, d, "queue_messages").select("id", M.retry_decision(ok, F.col("batch_no") % 9, F.lit(5000)).alias("r")).select("id", "r.outcome", "r.next_ms")


@query("""WITH RECURSIVE o AS (SELECT source AS session, doc_id AS seq, length(text) // 4 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IS NOT NULL),
  r AS (SELECT session, seq, k, 1 AS n, t AS used, t >= 2000 AS compress FROM o WHERE k = 1 UNION ALL
    SELECT o.session, o.seq, o.k, CASE WHEN compress THEN 1 ELSE n + 1 END, CASE WHEN compress THEN t ELSE used + t END, CASE WHEN compress THEN t >= 2000 ELSE n + 1 >= 10 OR used + t >= 2000 END FROM r JOIN o ON o.session = r.session AND o.k = r.k + 1)
  SELECT session, seq, compress FROM r""")
def compress_points(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("seq"), F.floor(F.length("text") / 4).alias("tokens"))
    return M.compress_points(turns, 10, 2000)


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM events)
  SELECT user_id, session, event_id, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS position FROM s WHERE event_type IN ('view', 'purchase') AND session > 0 QUALIFY position <= 4""")
def search_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = M.sessions_by(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type").isin("view", "purchase"))
    return s.select("user_id", "session", "event_id", "position")


@query("""SELECT user_id, count(*) FILTER (ts > TIMESTAMP '2024-01-02') AS hits_30d, epoch_us(max(ts)) AS last_us, round(sum(value), 4) AS value FROM events GROUP BY 1""")
def recent_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") > F.lit("2024-01-02").cast("timestamp_ntz")).alias("hits_30d"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"), F.round(F.sum("value"), 4).alias("value"))


@query("""WITH w AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, max(n) AS peak, sum(n) AS total, count(*) AS hours FROM w GROUP BY 1""")
def traffic(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count("*").alias("n"))
    return w.groupBy("event_type").agg(F.max("n").alias("peak"), F.sum("n").alias("total"), F.count("*").alias("hours"))


_PATHS = "(SELECT DISTINCT repo || '/' || file_path AS path FROM code_chunk)"


@query(f"""SELECT string_split(substr(path, length('harborline/ctxcore/') + 1), '/')[1] AS name, max(contains(substr(path, length('harborline/ctxcore/') + 1), '/')) AS is_folder FROM {_PATHS} WHERE starts_with(path, 'harborline/ctxcore/') GROUP BY 1""")
def folder_children(spark: SparkSession, d: str) -> DataFrame:
    return M.children_of(table(spark, d, "code_chunk").select(F.concat_ws("/", "repo", "file_path").alias("path")).distinct(), "harborline/ctxcore")


@query(f"""SELECT path, CASE WHEN path = 'harborline/ctxcore' OR starts_with(path, 'harborline/ctxcore/') THEN 'moved/core' || substr(path, length('harborline/ctxcore') + 1) ELSE path END AS renamed,
  CASE WHEN starts_with(path, 'harborline/ctxcore/lib/') THEN 'harborline/ctxcore/lib' WHEN starts_with(path, 'harborline/') THEN 'harborline' END AS mount FROM {_PATHS}""")
def folder_rename(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "code_chunk").select(F.concat_ws("/", "repo", "file_path").alias("path")).distinct()
    return p.select("path", M.renamed(F.col("path"), "harborline/ctxcore", "moved/core").alias("renamed"), M.mount_of(F.col("path"), ["harborline", "harborline/ctxcore/lib"]).alias("mount"))


_CL = _LINES.format("content")


@query(f"""SELECT chunk_id, md5(array_to_string(list_filter(list_transform({_CL}, lambda x: rtrim(x)), lambda x: NOT regexp_matches(x, '^\\s*(?:#|//|--)')), chr(10))) AS digest FROM code_chunk""")
def comment_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunk")
    kept = F.filter(F.transform(L.lines(F.col("content")), lambda x: F.rtrim(x)), lambda x: ~x.rlike(r"^\s*(?:#|//|--)"))
    return c.select("chunk_id", F.md5(F.array_join(kept, "\n")).alias("digest"))


_SIG = r"^\s*(?:export |pub |final |static |async )*(?:def|class|function|func|fn|interface|struct|enum|type|impl)\b"


@query(f"""WITH l AS (SELECT chunk_id, {_CL} AS l FROM code_chunk) SELECT chunk_id, array_to_string(list_filter(l, lambda x: regexp_matches(x, '{_SIG}')), chr(10)) AS signatures, len(l) - len(list_filter(l, lambda x: regexp_matches(x, '{_SIG}'))) AS elided FROM l""")
def signature_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunk")
    s = lambda x: F.filter(x, lambda r: r.rlike(_SIG))
    both = T.let(L.lines(F.col("content")), lambda x: F.struct(F.array_join(s(x), "\n").alias("signatures"), (F.size(x) - F.size(s(x))).alias("elided")))
    return c.select("chunk_id", both.alias("b")).select("chunk_id", "b.signatures", "b.elided")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  o AS (SELECT doc_id, i, regexp_extract(x, '^\\s*(ok|PASSED|FAILED|skipped) tests/', 1) AS outcome FROM l), f AS (SELECT *, outcome IN ('ok', 'PASSED') AS pass FROM o),
  r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, pass ORDER BY i) AS run FROM f)
  SELECT doc_id, count(*) FILTER (pass) AS passed, count(*) FILTER (outcome = 'FAILED') AS failed, count(*) FILTER (outcome = 'skipped') AS skipped, count(DISTINCT CASE WHEN pass THEN run END) AS passing_runs FROM r GROUP BY 1""")
def test_fold(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.transform(F.split("text", "\n"), lambda x: F.regexp_extract(x, r"^\s*(ok|PASSED|FAILED|skipped) tests/", 1))
    passing = lambda x: x.isin("ok", "PASSED")
    count = lambda k, f: F.size(F.filter(k, f))
    fold = T.let(kinds, lambda k: F.struct(
        count(k, passing).alias("passed"), count(k, lambda x: x == "FAILED").alias("failed"), count(k, lambda x: x == "skipped").alias("skipped"),
        F.size(F.filter(k, lambda x, i: passing(x) & ~F.coalesce(passing(F.get(k, i - 1)), F.lit(False)))).alias("passing_runs"),
    ))
    return table(spark, d, "documents").select("doc_id", fold.alias("f")).select("doc_id", "f.*")


@query("""WITH f AS (SELECT DISTINCT repo, file_path, lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM code_chunk), n AS (SELECT *, row_number() OVER (PARTITION BY repo, ext ORDER BY file_path) AS n FROM f)
  SELECT repo, ext, count(*) AS files, string_agg(file_path, ',' ORDER BY file_path) FILTER (n <= 5) AS sample FROM n GROUP BY ALL""")
def extension_groups(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "code_chunk").select("repo", "file_path", T.extension(F.col("file_path")).alias("ext")).distinct()
    first = F.slice(F.array_sort(F.collect_list("file_path")), 1, 5)
    salted = f.groupBy("repo", "ext", F.pmod(F.xxhash64("file_path"), F.lit(64)).alias("s")).agg(F.count("*").alias("n"), first.alias("p"))
    return salted.groupBy("repo", "ext").agg(F.sum("n").alias("files"), F.array_join(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, 5), ",").alias("sample"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT *, regexp_matches(x, 'FAILED|ERROR') AS hit FROM l),
  k AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS kept FROM h)
  SELECT doc_id, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS elided, md5(string_agg(x, chr(10) ORDER BY i) FILTER (kept)) AS digest FROM k GROUP BY 1""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    near = lambda x, i: F.exists(F.sequence(i - 2, i + 2), lambda j: F.coalesce(F.when(j >= 0, F.get(x, j)).rlike("FAILED|ERROR"), F.lit(False)))
    kept = T.let(F.split("text", "\n"), lambda x: F.struct(F.filter(x, lambda r, i: near(x, i)).alias("k"), F.size(x).alias("n")))
    rows = table(spark, d, "documents").select("doc_id", kept.alias("c"))
    size = F.size("c.k")
    return rows.select("doc_id", size.alias("kept"), (F.col("c.n") - size).alias("elided"), F.when(size > 0, F.md5(F.array_join("c.k", "\n"))).alias("digest"))


@query()
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    files = chunker.files(table(spark, d, "code_chunk"))
    return chunker.chunks(files).select("repo", "file_path", "symbol", "symbol_kind", "start_line", "end_line", "signature", "chunk_hash", F.size("calls").alias("calls"))


@query()
def json_structure(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queue_messages").select("id", chunker.json_summary()(F.col("data")).alias("summary"))


@query("""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda r: CASE WHEN length(r) <= 200 THEN r ELSE substr(r, 1, 200) || '...' END), chr(10))) AS narrow,
  md5(CASE WHEN length(text) <= 3000 THEN text ELSE substr(text, 1, 1800) || chr(10) || '... [' || (length(text) - 3000) || ' more characters]' || chr(10) || right(text, 1200) END) AS sixty_forty FROM documents""")
def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[F.md5(f(t)).alias(n) for n, f in S.COLUMNS.items()])


@query()
def shortened(spark: SparkSession, d: str) -> DataFrame:
    """Every stateful shortener over every document: how long the results are."""
    docs = table(spark, d, "documents").select("doc_id", *[F.length(f(F.col("text"))).alias(n) for n, f in S.COLUMNS.items()], S.lengths(F.col("text")).alias("l"))
    return docs.select("doc_id", *[n if n in S.COLUMNS else f"l.{n}" for n in S.SHORTENERS])

