"""Queries for the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import lines as L
from millrace.functions import text as T
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

# The SQL has literals of its own, so that it also checks the fixed values of the operators.
_STOP = """['the', 'and', 'for', 'with', 'from', 'into', 'that', 'this', 'when', 'what', 'where', 'which', 'how', 'does', 'dont', 'doesnt', 'handle', 'nicely', 'issue', 'expected', 'actual',
  'behavior', 'possible', 'file', 'hints', 'before', 'after', 'function', 'method', 'class', 'module', 'call', 'calls', 'using', 'used']"""
_TOKENS = "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]+'), lambda x: lower(x)), lambda x: NOT list_contains(" + _STOP + ", x))"
_HAN = "(length({0}) - length(regexp_replace({0}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3400}}-\\x{{4dbf}}]', '', 'g')))"


@query(f"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE CAST(floor({_HAN.format('text')} / 1.5) AS BIGINT)
  + greatest(1, (length(text) - {_HAN.format('text')}) // 4) END AS tokens FROM documents""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS digest FROM documents")
def index_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.index_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(f"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: NOT list_contains({_STOP}, lower(x)))) AS t,
    generate_subscripts(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: NOT list_contains({_STOP}, lower(x))), 1) AS i FROM eval_item),
  f AS (SELECT item_id, arg_min(t, i) AS t, min(i) AS i FROM w GROUP BY item_id, lower(t))
  SELECT item_id, string_agg(t, ' ' ORDER BY i) AS terms FROM f GROUP BY item_id""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query(f"""SELECT chunk_id, array_to_string({_TOKENS.format("regexp_replace(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')")}, ' ') AS parts
  FROM code_chunk WHERE symbol IS NOT NULL""")
def identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunk").where("symbol IS NOT NULL").select("chunk_id", F.array_join(T.identifier_parts(F.col("symbol")), " ").alias("parts"))


_MATCHED = "regexp_matches(lower(text), '{}')"


@query(f"""SELECT item_id, CASE
  WHEN {_MATCHED.format('decided|decision|chose|chosen|agreed|concluded|outcome|result|resolution')} OR {_MATCHED.format('(what did|why did|how did).*(decide|choose|pick|conclude)')} THEN 'historical_decisions'
  WHEN {_MATCHED.format("pending|todo|still need|remaining|left to|not yet|unfinished|open loop|follow.?up|blocker|waiting for|what''s left|what remains|outstanding")} THEN 'open_items'
  WHEN {_MATCHED.format('how to|how do|steps? to|procedure|process|method|best practice|pattern|approach|workflow|guide|tutorial|instructions?')} THEN 'reusable_skills'
  WHEN {_MATCHED.format('who is|who are|what is|relationship between|works? at|belongs? to|connected to|related to|team|group|department|org')} THEN 'entity_relations'
  ELSE 'background_supplement' END AS intent FROM eval_item""")
def intent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").select("item_id", T.intent(F.col("text")).alias("intent"))


@query(f"""WITH h AS (SELECT doc_id, {_MATCHED.format('偏好|背景|身份|记忆|回顾|profile|preference|background|remember')} AS memory,
    {_MATCHED.format('怎么做|步骤|命令|流程|how[ \\t\\n\\r\\f]*to|workflow|procedure|instruction|tutorial')} AS skill, {_MATCHED.format('文档|资料|规范|链接|document|spec|reference|link|paper|article')} AS resource FROM documents)
  SELECT doc_id, CASE WHEN skill AND NOT memory AND NOT resource THEN 'SKILL' WHEN resource AND NOT memory AND NOT skill THEN 'RESOURCE' ELSE 'MEMORY' END AS query_type FROM h""")
def query_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.query_type(F.col("text")).alias("query_type"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '```(?s:.*?)```', '', 'g'), 'Sender\s*\(untrusted metadata\)\s*:\s*', '', 'g'), '\[[\w\s:\-]+UTC\]\s*', '', 'g'))) AS digest FROM documents""")
def clean_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_query(F.col("text"))).alias("digest"))


_COUNT = "len(regexp_extract_all(text, '{}'))"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh-CN'
  WHEN {_COUNT.format('[\\x{ac00}-\\x{d7af}]')} >= 2 AND {_COUNT.format('[\\x{ac00}-\\x{d7af}]')} / greatest({_COUNT.format('[^\\s]')}, 1) >= 0.1 THEN 'ko'
  WHEN {_COUNT.format('[\\x{0400}-\\x{04ff}]')} >= 2 AND {_COUNT.format('[\\x{0400}-\\x{04ff}]')} / greatest({_COUNT.format('[^\\s]')}, 1) >= 0.1 THEN 'ru' ELSE 'en' END AS script FROM documents""")
def script_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("script"))


_SYN = """WHEN k IN ('coffee', 'tea', 'drink') THEN 'beverage' WHEN k IN ('transport', 'transportation', 'travel_to_work') THEN 'commute' WHEN k IN ('notes', 'note_tool') THEN 'note_taking'
  WHEN k IN ('code_style', 'programming_style', 'coding_preference') THEN 'coding_style' WHEN k IN ('music_taste', 'music_preference') THEN 'music' WHEN k IN ('food_preference', 'diet', 'eating') THEN 'food'
  WHEN k IN ('workout', 'fitness', 'gym') THEN 'exercise' WHEN k IN ('books', 'reading_preference') THEN 'reading' WHEN k IN ('sleep_habit', 'sleep_schedule') THEN 'sleep'
  WHEN k = 'weather_preference' THEN 'weather' WHEN k IN ('pet', 'animals') THEN 'pets'"""


@query(f"""WITH s AS (SELECT chunk_id, symbol, coalesce(language, 'none') AS category, regexp_replace(translate(trim(lower(symbol)), ' -', '__'), '_+', '_', 'g') AS k FROM code_chunk)
  SELECT chunk_id, CASE WHEN coalesce(symbol, '') = '' THEN category {_SYN} ELSE k END AS routing_key FROM s""")
def routing_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunk").select("chunk_id", T.routing_key(F.col("symbol"), F.coalesce("language", F.lit("none"))).alias("routing_key"))


@query("""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '\\s+', '-', 'g'), '[^a-z0-9_-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM eval_item""")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_item").select("item_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text WHEN length(text) <= 1100 THEN substr(text, 1, 997) || '...' END) AS digest, length(text) > 1100 AS rejected FROM documents")
def fit_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.fit_length(F.col("text"), 1000)).alias("digest"), (F.length("text") > 1100).alias("rejected"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS digest FROM documents""")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.html_escape(F.col("text"))).alias("digest"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'File\s+"[^"\n]*",\s+line\s+\d+', 'File "...", line <N>', 'g'), '0x[0-9a-fA-F]+', '<ADDR>', 'g'), '\berrno\s*[=:]\s*\d+', 'errno=<N>', 'g')) AS errors,
  md5(regexp_replace(regexp_replace(text, '\d+\.\d+', '<VER>', 'g'), '/[^\s]+', '<PATH>', 'g')) AS warnings FROM documents""")
def template_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.error_key(F.col("text"))).alias("errors"), F.md5(T.warning_key(F.col("text"))).alias("warnings"))


# every kind of line end counts, and a last one opens no further line; an empty text has no line
_LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace(regexp_replace({0}, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{{0085}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '\\n$', ''), chr(10)) END"
_L = _LINES.format("text")
_ERR = r"(?i:^\s*(?:error|severe|fail|failed|failure|exception)\b)|(?i:^\s*errno\s*[=:]\s*\d+)|^\s*Traceback\s*\(most recent call last\)|^\s*File\s+\".*\",\s+line\s+\d+"
_WARN = r"(?i:^\s*(?:warn|warning|deprecated|deprecation|caution|unsupported)\b)"
_CRIT = r"^\s*(?:(?:def|class|async def)\s+\w+|(?:import|from)\s+|#|(?:if|else|elif|for|while|try|except|finally)\s*[:(])|(?i:^\s*(?:error|severe|exception|failed|return|raise|yield)\b)"


@query(f"""SELECT doc_id, len(list_filter({_L}, lambda x: regexp_matches(x, '{_ERR}'))) AS errors, len(list_filter({_L}, lambda x: regexp_matches(x, '{_WARN}'))) AS warnings,
  len(list_filter({_L}, lambda x: regexp_matches(x, '{_CRIT}'))) AS critical FROM documents""")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", L.count_lines(t, fixed.ERROR_LINE).alias("errors"), L.count_lines(t, fixed.WARNING_LINE).alias("warnings"), L.count_lines(t, fixed.CRITICAL_LINE).alias("critical")
    )


_HITS = "CAST(regexp_matches({0}, '{1}') AS INT)"


def _sum(column: str, *patterns: str) -> str:
    return " + ".join(_HITS.format(column, p) for p in patterns)


_ERRORS = _sum("text", r"(?i)\b(error|severe|fatal|exception|failed)", r"Traceback\s*\(most recent call last\)", r'(?m)^\s*File\s+".*",\s+line\s+\d+', r"(?i)\bfailed to\b")
_CODE = _sum("head", r"(?m)^\s*(def|class|async\s+def|import|from|const|let|var|function)\s+", r"(?m)^\s*(if|else|elif|for|while|try|except|catch|switch)\s*[({]?", r"(?m)^\s*#", r'\{\s*"[^"]+":')
_LOG = _sum(
    "head", r"(?m)^(\s*\d+\s+)?\d\d\d\d-\d\d-\d\d[\sT]", r"(?m)^\[\s*(DEBUG|INFO|WARN|ERROR|FATAL)", r"(?im)^\[(summary|trace|failure|debug|info|warn|error|fatal)\]",
    r"(?m)^(failure_count|function_count|expected_source)=", r"(?i)\b(log|print|echo|printf|console\.log)\s*\(", r"(?m)^\s*at\s+[\w.$]+\([^)]*\)\s*$",
)
_STAMPED = r"(?m)^\s*(?:\d+\s+)?(?:\d\d\d\d-\d\d-\d\d[\sT].*\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b|\[(?:summary|trace|failure|debug|info|warn|warning|error|fatal)\])"
_NOTES = _sum("head", r"(?im)^(context|memory|archive|overview|abstract):", r"(?m)^\s*-\s+[\w\s]+:", r"(?m)^\s*##\s+\w+")


@query(f"""WITH t AS (SELECT doc_id, text, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS head FROM documents),
  s AS (SELECT doc_id, text, {_ERRORS} AS e, {_CODE} AS c, {_LOG} AS l, len(regexp_extract_all(head, '{_STAMPED}')) AS stamped, {_NOTES} AS m FROM t)
  SELECT doc_id, CASE WHEN coalesce(length(trim(text)), 0) < 10 THEN 'GENERIC' WHEN e >= 2 THEN 'ERROR' WHEN c >= 3 THEN 'CODE' WHEN l >= 2 OR stamped >= 3 THEN 'LOG' WHEN m >= 2 THEN 'MEMORY' ELSE 'GENERIC' END AS content_type FROM s""")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_type(F.col("text")).alias("content_type"))


_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"


@query(f"""SELECT chunk_id, CASE WHEN language <> '' THEN trim(lower(language)) WHEN {_EXT} = 'py' THEN 'python' WHEN {_EXT} = 'js' THEN 'javascript' WHEN {_EXT} = 'ts' THEN 'typescript' WHEN {_EXT} = 'rs' THEN 'rust'
    WHEN {_EXT} IN ('cc', 'cpp', 'cxx') THEN 'cpp' WHEN {_EXT} IN ('tsx', 'jsx', 'go', 'java', 'c') THEN {_EXT} ELSE 'unknown' END AS file_language,
  regexp_matches(file_path, '(?i)[^/]\\.(py|tsx?|jsx?|go|rs|java|c|cc|cpp|cxx|h|hpp)$') AND NOT regexp_matches(file_path, '^/|(^|/)\\.\\.(/|$)')
    AND NOT regexp_matches(file_path, '(^|/)(\\.git|\\.hg|\\.svn|__pycache__|\\.pytest_cache|\\.mypy_cache|\\.ruff_cache|\\.venv|venv|env|node_modules|dist|build|coverage|\\.next|\\.turbo|\\.cache[^/]*)(/|$)') AS code_path FROM code_chunk""")
def file_language(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("file_path")
    return table(spark, d, "code_chunk").select("chunk_id", T.file_language(p, F.col("language")).alias("file_language"), T.is_code_path(p).alias("code_path"))


@query(r"""SELECT chunk_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(signature, '\(\?:[^)]*\)', ' ', 'g'), '\\.', ' ', 'g'), '[|()?+*]', ' ', 'g'), '\s+', ' ', 'g')), 1, 1500) AS words FROM code_chunk""")
def pattern_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunk").select("chunk_id", T.pattern_words(F.col("signature")).alias("words"))


@query("""SELECT chunk_id, md5(CASE WHEN starts_with(coalesce(content, ''), h) THEN coalesce(content, '') ELSE h || coalesce(content, '') END) AS digest FROM (
  SELECT chunk_id, content, '# ' || regexp_extract(file_path, '([^/]+/)?[^/]+$', 0) || CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN ' (lines ' || start_line || '-' || end_line || ')' ELSE '' END || chr(10) || chr(10) AS h FROM code_chunk)""")
def location_header(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunk").select("chunk_id", F.md5(T.with_location(F.col("content"), F.col("file_path"), F.col("start_line"), F.col("end_line"))).alias("digest"))


@query("""SELECT id, substr(sha256(uri || ':' || level), 1, 16) AS record_id, regexp_replace(regexp_replace(uri, '/+$', ''), '[^/]+$', '') AS parent,
  CASE WHEN regexp_matches(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$') THEN regexp_extract(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$', 1) END AS account,
  CASE WHEN regexp_matches(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$') THEN regexp_extract(uri, '^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$', 3) END AS owner FROM index_record""")
def uri_functions(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uri")
    p = T.uri_parts(u)
    return table(spark, d, "index_record").select("id", T.record_id(u, F.col("level")).alias("record_id"), T.parent_uri(u).alias("parent"), p["account"].alias("account"), p["owner"].alias("owner"))


@query("""SELECT id, round(coalesce(ln(1 + coalesce(active_count, 0)) / (ln(1 + coalesce(active_count, 0)) + 1) * exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMP '2026-01-01') - epoch_us(updated_at)) / 86400000000.0) / 7), 0), 6) AS hotness FROM index_record""")
def hotness(spark: SparkSession, d: str) -> DataFrame:
    h = T.hotness(F.col("active_count"), F.col("updated_at").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))
    return table(spark, d, "index_record").select("id", F.round(h, 6).alias("hotness"))


@query("SELECT id, batch_no % 12 AS retries, CAST(least(60000, 1000 * pow(2, batch_no % 12)) AS BIGINT) AS wait_ms FROM queue_messages")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("batch_no") % 12
    return table(spark, d, "queue_messages").select("id", n.alias("retries"), T.backoff_ms(n).alias("wait_ms"))


@query("""WITH h AS (SELECT item_id, sha256(text) AS h FROM eval_item), v AS (SELECT item_id, i, (CAST('0x' || substr(h, 2 * (i % 32) + 1, 2) AS INT) - 128) / 128.0 AS x FROM h, range(384) AS r(i))
  SELECT item_id, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares, round(sum(x * i), 6) AS weighted FROM v GROUP BY item_id""")
def hash_vector(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "eval_item").select("item_id", F.posexplode(T.hash_vector(F.col("text"))).alias("i", "x"))
    return v.groupBy("item_id").agg(F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("squares"), F.round(F.sum(F.col("x") * F.col("i")), 6).alias("weighted"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, md5(right(text, 300)) AS newest, md5(substr(text, 101, 200)) AS slice FROM documents")
def digests_and_slices(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("md5"), F.sha2(t, 256).alias("sha256"), F.md5(F.right(t, F.lit(300))).alias("newest"), F.md5(F.substring(t, 101, 200)).alias("slice"))


_VALID = "CASE WHEN json_valid(data) THEN data END"


@query(f"""SELECT id, json_extract_string({_VALID}, '$.event_type') AS event_type, json_extract_string({_VALID}, '$.uri') AS uri FROM queue_messages""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queue_messages").select("id", F.get_json_object("data", "$.event_type").alias("event_type"), F.get_json_object("data", "$.uri").alias("uri"))


@query("""SELECT id, epoch_us(make_timestamp(CASE WHEN abs(timestamp) >= 100000000000 THEN timestamp * 1000 ELSE timestamp * 1000000 END)) AS sent_us, lower(status) AS status FROM queue_messages""")
def session_time(spark: SparkSession, d: str) -> DataFrame:
    from millrace.streaming.exactly_once import event_time

    return table(spark, d, "queue_messages").select("id", F.unix_micros(event_time(F.col("timestamp"))).alias("sent_us"), F.lower("status").alias("status"))


@query(f"""WITH l AS (SELECT doc_id, text, {_L} AS l FROM documents)
  SELECT doc_id, md5(CASE WHEN text IS NULL OR len(l) <= 20 THEN text ELSE array_to_string(list_concat(list_concat(l[1:10], ['... [' || (len(l) - 20) || ' lines left out] ...']), l[len(l) - 9:]), chr(10)) END) AS digest FROM l""")
def head_tail(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.head_tail(F.col("text"), 20)).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, text, {_L} AS l FROM documents)
  SELECT doc_id, md5(CASE WHEN text IS NULL OR len(l) <= 20 THEN text ELSE array_to_string(list_concat(list_concat(l[1:6], list_filter(l[7:len(l) - 6], lambda x: regexp_matches(x, '{_CRIT}'))[1:8]), l[len(l) - 5:]), chr(10)) END) AS digest FROM l""")
def critical_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.critical_first(F.col("text"), 20)).alias("digest"))


_ANY = r"(?i:(?:error|exception|failed|panic)[:\s]|(?:^|\s)\[failure\]|^failure_count\s*=\s*[1-9])|Traceback \(most recent call last\)"


@query(f"""WITH l AS (SELECT doc_id, text, {_L} AS l FROM documents)
  SELECT doc_id, md5(CASE WHEN text IS NULL OR len(l) <= 20 THEN text ELSE array_to_string(list_concat(list_concat(list_concat(l[1:10], list_transform(list_filter(l, lambda x: regexp_matches(x, '{_ANY}')), lambda x: trim(x))[1:5]),
    list_transform(list_filter(l, lambda x: contains(lower(x), 'warning') OR contains(lower(x), 'warn:')), lambda x: trim(x))[1:5]), l[len(l) - 4:]), chr(10)) END) AS digest FROM l""")
def line_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.summary(F.col("text"), 20)).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, unnest({_L}) AS x, generate_subscripts({_L}, 1) AS i FROM documents),
  f AS (SELECT *, CASE WHEN i = 1 OR trim(x) <> lag(trim(x)) OVER w THEN 1 ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
  r AS (SELECT doc_id, g, count(*) AS n, arg_min(x, i) AS first FROM g GROUP BY doc_id, g),
  o AS (SELECT doc_id, g, CASE WHEN trim(first) = '' THEN CASE WHEN g = 1 THEN NULL ELSE '' END WHEN n > 3 THEN trim(first) || chr(10) || '[repeated ' || n || ' times]' ELSE rtrim(repeat(first || chr(10), n::INT), chr(10)) END AS t FROM r)
  SELECT d.doc_id, CASE WHEN any_value(text) IS NOT NULL THEN md5(coalesce(string_agg(t, chr(10) ORDER BY g), '')) END AS digest FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id""")
def line_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.runs(F.col("text"))).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, unnest({_L}) AS x, generate_subscripts({_L}, 1) AS i FROM documents),
  k AS (SELECT *, CASE WHEN regexp_matches(x, '{_WARN}') THEN regexp_replace(regexp_replace(trim(x), '\\d+\\.\\d+', '<VER>', 'g'), '/[^\\s]+', '<PATH>', 'g') END AS k FROM l),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM k)
  SELECT d.doc_id, CASE WHEN any_value(text) IS NOT NULL THEN md5(coalesce(string_agg(x, chr(10) ORDER BY i), '')) END AS digest FROM documents d LEFT JOIN (SELECT * FROM n WHERE k IS NULL OR n = 1) m ON m.doc_id = d.doc_id GROUP BY d.doc_id""")
def distinct_warnings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.distinct_warnings(F.col("text"))).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, {_L} AS l FROM documents)
  SELECT doc_id, md5(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\\s*(?:ok|PASSED|skipped) |INFO|DEBUG') OR regexp_matches(x, 'not (?:ready|found)')), chr(10))) AS digest FROM l""")
def noise_drop(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(L.drop_lines(F.col("text"), r"^\s*(?:ok|PASSED|skipped) |INFO|DEBUG", "not (?:ready|found)")).alias("digest"))
