"""Queries for the outputs of commands and for prompts. Their SQL has literals of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import outputs as O
from millrace.functions import replies as P
from millrace.operators import usage as U
from millrace.plans.registry import Registry
from millrace.plans.scalars import _L, _LINES
from millrace.sources.tables import table

R = Registry()
query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

_KIND = """CASE WHEN regexp_matches(head, 'passed|failed|error|test|ok') THEN 'test' WHEN regexp_matches(head, 'compiling|building|cargo|make|warning') THEN 'build'
  WHEN regexp_matches(head, 'debug|info|warn|trace|\\[0m|http://') THEN 'log' WHEN regexp_matches(text, '^\\s*[{\\[]') THEN 'json' ELSE 'generic' END"""


@query(f"SELECT doc_id, {_KIND} AS kind FROM (SELECT doc_id, text, lower(array_to_string(({_L})[1:10], chr(10))) AS head FROM documents)")
def output_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", O.output_kind(F.col("text")).alias("kind"))


def _drop_sql(drop: str, keep: str, what: str) -> str:
    kept = f"list_filter(l, lambda x: regexp_matches(x, '{keep}') OR NOT regexp_matches(x, '{drop}'))"
    return f"""SELECT doc_id, md5(array_to_string(CASE WHEN len({kept}) < len(l) THEN list_append({kept}, '... [{what}: ' || (len(l) - len({kept})) || ' lines left out]') ELSE {kept} END, chr(10))) AS digest
      FROM (SELECT doc_id, {_L} AS l FROM documents)"""


@query(
    _drop_sql(
        r"^Requirement already satisfied:|^Collecting |^\s*(Downloading |Using cached |Preparing metadata|Building wheel|Created wheel|Stored in directory)|^\s*\|.*\|.*kB",
        r"^Successfully (un)?installed|^\s*ERROR|^WARNING|package needs to be reinstalled|Could not find",
        "install progress",
    )
)
def install_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(O.without_install_progress(F.col("text"))).alias("digest"))


@query(_drop_sql(r'^\d+\.\d+\.\d+\.\d+ - - \[|"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH) |^[A-Z][a-z]+ HTTP/\d', r"Traceback \(most recent call last\)|Exception|\b5\d\d\b|ERROR", "access log"))
def access_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(O.without_access_log(F.col("text"))).alias("digest"))


_PASS = r"regexp_matches(lower(x), 'passed|^\s*(ok|pass)\s+\d+')"
_FAIL = rf"(NOT {_PASS} AND regexp_matches(lower(x), 'failed|^\s*(fail|failure)\s+\d+'))"
_BAD = rf"(NOT {_PASS} AND NOT {_FAIL} AND regexp_matches(lower(x), 'error|traceback'))"
_N = "len(list_filter(l, lambda x: {0}))"
_TEST_SQL = f"""list_concat(list_concat(list_concat(list_transform(list_filter(l, lambda x: {_PASS} OR {_FAIL}), lambda x: trim(x))[1:20], CASE WHEN {_N.format(_BAD)} > 0 THEN ['Errors:'] ELSE [] END),
  list_transform(list_filter(l, lambda x: {_BAD}), lambda x: trim(x))[1:10]), CASE WHEN {_N.format(_PASS)} + {_N.format(_FAIL)} > 0 THEN [{_N.format(_PASS)} || ' passed, ' || {_N.format(_FAIL)} || ' failed'] ELSE [] END)"""
_BUILD_SQL = """list_concat(list_concat(l[1:15], CASE WHEN len(list_filter(l, lambda x: regexp_matches(lower(x), 'error|warning:'))) > 0 THEN list_concat(['--- errors and warnings'], list_filter(l, lambda x: regexp_matches(lower(x), 'error|warning:'))[1:5]) ELSE [] END),
  CASE WHEN len(l) > 15 THEN list_concat(['---'], l[greatest(len(l) - 9, 1):]) ELSE [] END)"""
_JSON_SQL = """list_concat(list_concat(list_concat(['{'], list_transform(list_filter(list_transform(l[1:30], lambda x: trim(x)), lambda x: starts_with(x, '"')), lambda x: '  ' || string_split(x, '"')[2] || ': ...')),
  CASE WHEN len(l) > 30 THEN ['  ... [' || (len(l) - 30) || ' more lines]'] ELSE [] END), ['}'])"""


@query(f"""SELECT doc_id, md5(array_to_string({_TEST_SQL}, chr(10))) AS test, md5(array_to_string({_BUILD_SQL}, chr(10))) AS build, md5(array_to_string({_JSON_SQL}, chr(10))) AS json FROM (SELECT doc_id, {_L} AS l FROM documents)""")
def compact_outputs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(O.compact_test(t)).alias("test"), F.md5(O.compact_build(t)).alias("build"), F.md5(O.compact_json(t)).alias("json"))


@query(r"""SELECT id, CASE WHEN e IN ('test_runner', 'diff') THEN e WHEN e = 'diff_maybe' THEN CASE WHEN regexp_matches(data, '(?m)^diff --git a/') OR regexp_matches(data, '(?m)^@@\s+-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@') THEN 'diff' ELSE '' END
    WHEN e = 'python_maybe' THEN CASE WHEN regexp_matches(data, 'Traceback \(most recent call last\)|\b\w*(Error|Exception):') THEN 'python_error' ELSE '' END WHEN regexp_matches(c, '(^|[\s;&|()])git\s+diff\b') THEN 'diff' ELSE '' END AS outcome,
  string_split(list_filter(string_split_regex(trim(c), '\s+'), lambda w: NOT regexp_matches(w, '^[A-Za-z_]\w*=') AND w <> '')[1], '/')[-1] AS program
  FROM (SELECT id, coalesce(data, '') AS data, ['test_runner', 'diff', 'diff_maybe', 'python_maybe', ''][1 + id % 5] AS e, 'A=1 B=x /usr/bin/' || status || ' && git diff ' || id AS c FROM queue_messages WHERE status IS NOT NULL)""")
def command_outcomes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "queue_messages").where("status IS NOT NULL")
    kinds = F.array(*[F.lit(x) for x in ("test_runner", "diff", "diff_maybe", "python_maybe", "")])
    command = F.concat(F.lit("A=1 B=x /usr/bin/"), F.col("status"), F.lit(" && git diff "), F.col("id").cast("string"))
    return m.select("id", O.command_output(command, F.coalesce("data", F.lit("")), kinds[(F.col("id") % 5).cast("int")]).alias("outcome"), O.command_word(command).alias("program"))


_SHOWS = {
    "error": r"\b(error|failed|crash|bug|exception|traceback|panicked|panicke)\b", "implementation": r"\b(implement|add|create|write|build|develop)\b", "refactoring": r"\b(refactor|restructure|improve|optimize|rewrite)\b",
    "research": r"\b(find|search|investigate|look\s+for|check|analyze|explore)\b", "documentation": r"\b(document|explain|describe|comment|docstring)\b",
    "question": r"\b(how\s+do\s+i|how\s+can\s+i|what\s+is|why\s+does|can\s+you|help\s+me|tell\s+me|what\s+if)\b", "code-review": r"\b(review|audit|assess)\b|\bevalua", "debugging": r"\b(debug|fix|patch|repair|solve)\b",
    "testing": r"\b(test|spec|verify|pytest|unittest)\b", "configuration": r"\b(config|configure|configuration|setup|install|deploy|env|environment)\b", "git": r"\b(commit|branch|merge|rebase|stash|git)\b", "shell": r"\b(shell|command\s+line|bash|script|cli)\b",
}
# a letter of any script beside a word belongs to it
_SHOWS = {n: p.replace(r"\b(", r"(?:^|[^\pL\pN_])(").replace(r")\b", r")(?:$|[^\pL\pN_])").replace(r"\bevalua", r"(?:^|[^\pL\pN_])evalua") for n, p in _SHOWS.items()}
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _SHOWS.items()) + "], lambda x: x IS NOT NULL)"
_FIRST = r"list_filter(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:5], lambda w: length(w) > 2 AND regexp_matches(w, '^\pL+$'))[1:3]"


@query(rf"""SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN '' WHEN len({_FOUND}) > 0 THEN array_to_string({_FOUND}, ',') WHEN len({_FIRST}) > 0 THEN array_to_string({_FIRST}, ',') ELSE 'general' END AS keywords,
  coalesce(CASE WHEN length(regexp_extract(text, '(?i)\b(analyze|build|create|fix|implement|add|update|modify)\s+(the\s+)?(\w+)', 3)) > 2 THEN regexp_extract(text, '(?i)\b(analyze|build|create|fix|implement|add|update|modify)\s+(the\s+)?(\w+)', 3) END,
    CASE WHEN length(regexp_extract(text, '(?i)\b(working\s+on|project|file|module|function|class|api)\s+(\w+)', 2)) > 2 THEN regexp_extract(text, '(?i)\b(working\s+on|project|file|module|function|class|api)\s+(\w+)', 2) END) AS topic FROM documents""")
def prompt_keywords(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", O.prompt_keywords(t).alias("keywords"), O.prompt_topic(t).alias("topic"))


_LINE = f"(SELECT doc_id, text, {_L} AS l, substr(text, 1, 500) AS head FROM documents)"
_DEF = r"^\s*(?:async\s+)?(def|class)\s+(\w+)"


@query(rf"""SELECT doc_id, concat_ws(',', 'patch', nullif(array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?m)^--- a/(\S+)', 1), regexp_extract_all(text, '(?m)^\+\+\+ b/(\S+)', 1))))[1:5], ','), '')) AS patch,
  concat_ws(',', 'tool_call', coalesce(nullif(regexp_extract(text, '<name>(\w+)</name>', 1), ''), nullif(regexp_extract(text, '"name":\s*"(\w+)"', 1), ''), nullif(regexp_extract(text, 'Calling tool:\s*(\w+)', 1), ''))) AS call,
  concat_ws(',', 'code', nullif(array_to_string(list_filter(list_transform(l[1:30], lambda x: CASE WHEN regexp_matches(x, '{_DEF}') THEN regexp_extract(x, '{_DEF}', 1) || ':' || regexp_extract(x, '{_DEF}', 2) WHEN regexp_matches(x, '^\s*@(\w+)') THEN 'decorator:' || regexp_extract(x, '^\s*@(\w+)', 1) END), lambda x: x IS NOT NULL)[1:5], ','), '')) AS code,
  CASE WHEN regexp_matches(text, '(?m)^--- a/|^\+\+\+ b/') OR contains(text, 'diff --git') THEN 'patch' WHEN contains(text, '<tool_call>') OR contains(head, 'Calling tool:') OR (contains(head, '"name":') AND contains(head, '"arguments":')) THEN 'tool_call'
    WHEN contains(text, 'Traceback (most recent call last)') OR (regexp_matches(head, '\b(Error|Exception|Failed|failed|error|SEVERE)\b') AND length(text) > 200) THEN 'error'
    WHEN length(text) > 500 AND (regexp_matches(head, '(?im)^Let me think|First,? I|In summary,? |Therefore,? |The answer is') OR regexp_matches(head, '(?m)^Step \d+[.:]\s|^\d+\.\s+[A-Z]|^-\s+[A-Z][a-z]')) THEN 'reasoning' ELSE 'other' END AS kind FROM {_LINE}""")
def reply_words(spark: SparkSession, d: str) -> DataFrame:
    """The kind of every text (code and generic as one), and the keywords of three kinds."""
    t = F.col("text")
    kind = P.reply_kind(t)
    return table(spark, d, "documents").select("doc_id", P.patch_words(t).alias("patch"), P.call_words(t).alias("call"), P.code_words(t).alias("code"), F.when(kind.isin("code", "generic"), "other").otherwise(kind).alias("kind"))


@query("""WITH c AS (SELECT user_id AS session, event_type AS tool, CASE WHEN value > 20 THEN 'completed' ELSE 'failed' END AS status, CAST(floor(value * 10) AS BIGINT) AS ms, event_id % 7 AS tokens FROM events)
  SELECT session, string_agg('- ' || tool || ': ' || n || ' calls, ' || good || ' good, ' || (n - good) || ' bad', chr(10) ORDER BY n DESC, tool) AS report, CAST(sum(ms) AS BIGINT) AS ms, CAST(sum(tokens) AS BIGINT) AS tokens
  FROM (SELECT session, tool, count(*) AS n, count(*) FILTER (status = 'completed') AS good, sum(coalesce(ms, 0)) AS ms, sum(tokens) AS tokens FROM c GROUP BY 1, 2) GROUP BY 1""")
def tool_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    calls = e.select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.when(F.col("value") > 20, "completed").otherwise("failed").alias("status"), F.floor(F.col("value") * 10).alias("ms"), (F.col("event_id") % 7).alias("tokens"))
    stats = U.tool_stats(calls)
    return U.tool_report(stats).join(stats.groupBy("session").agg(F.sum("ms").alias("ms"), F.sum("tokens").alias("tokens")), "session")


@query(rf"""WITH l AS (SELECT doc_id, trim(x) AS line FROM (SELECT doc_id, unnest({_L}) AS x FROM documents) WHERE regexp_matches(x, '(?i:^\s*(?:error|severe|fail|failed|failure|exception)\b)|(?i:^\s*errno\s*[=:]\s*\d+)|^\s*Traceback\s*\(most recent call last\)|^\s*File\s+".*",\s+line\s+\d+')),
  t AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(line, 'File\s+"[^"\n]*",\s+line\s+\d+', 'File "...", line <N>', 'g'), '0x[0-9a-fA-F]+', '<ADDR>', 'g'), '\berrno\s*[=:]\s*\d+', 'errno=<N>', 'g') AS template FROM l)
  SELECT template, count(*) AS lines, count(DISTINCT doc_id) AS texts, min(line) AS example FROM t GROUP BY 1""")
def line_templates(spark: SparkSession, d: str) -> DataFrame:
    return U.line_templates(table(spark, d, "documents"), fixed.ERROR_LINE)


@query("""WITH f AS (SELECT repo || '/' || file_path AS path, count(DISTINCT chunk_id) AS chunks FROM code_chunk GROUP BY 1), p AS (SELECT path, chunks, string_split(path, '/') AS p FROM f),
  a AS (SELECT array_to_string(p[1:k], '/') AS folder, chunks FROM (SELECT p, chunks, unnest(range(0, len(p))) AS k FROM p)) SELECT folder, count(*) AS files, CAST(sum(chunks) AS BIGINT) AS chunks FROM a GROUP BY 1""")
def folder_sums(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "code_chunk").groupBy(F.concat_ws("/", "repo", "file_path").alias("path")).agg(F.count_distinct("chunk_id").alias("n"))
    return U.rolled_up(files, {"chunks": F.col("n")})


_PROFILES = (
    O.Profile("tests", "test_runs", commands=("pytest",), categories=("test_log",), patterns=(r"\bPASSED\b", r"\bFAILED\b"), priority=2),
    O.Profile("python", "python_outline", extensions=("py",), patterns=(r"(?m)^def ",), priority=1),
    O.Profile("logs", "narrow", categories=("tool_log", "test_log"), priority=1),
)


@query(r"""WITH t AS (SELECT doc_id, source, CASE WHEN regexp_matches(text, '\b(PASSED|FAILED)\b') THEN 50 ELSE 0 END + CASE WHEN source = 'test_log' THEN 80 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 100 ELSE 0 END AS a,
    CASE WHEN regexp_matches(text, '(?m)^def ') THEN 50 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 30 ELSE 0 END AS b, CASE WHEN source IN ('tool_log', 'test_log') THEN 80 ELSE 0 END AS c FROM documents)
  SELECT doc_id, CASE WHEN greatest(a, b, c) < 30 THEN NULL WHEN a >= b AND a >= c THEN 'tests' WHEN b >= c THEN 'python' ELSE 'logs' END AS profile, CASE WHEN greatest(a, b, c) >= 30 THEN greatest(a, b, c) END AS score FROM t""")
def routed_outputs(spark: SparkSession, d: str) -> DataFrame:
    command = F.when(F.col("doc_id") % 5 == 0, "X=1 /bin/pytest -q").otherwise("ls")
    path = F.when(F.col("doc_id") % 3 == 0, "a/b.PY").otherwise("a/b")
    best = O.routed(F.col("text"), command, path, F.col("source"), _PROFILES)
    return table(spark, d, "documents").select("doc_id", best.alias("r")).select("doc_id", F.col("r.name").alias("profile"), "r.score")


@query()
def shortened_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every mode, the adaptive one, and outputs condensed by their kind: the digests of what is left."""
    t = F.col("text")
    modes = [F.md5(O.shortened(t, m)).alias(m) for m in O.MODES]
    return table(spark, d, "documents").select("doc_id", *modes, F.md5(O.adaptive(t)["text"]).alias("adaptive"), F.md5(O.compacted(t)).alias("compacted"))
