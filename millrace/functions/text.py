"""Column functions on text, names and paths. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Two tokens for three ideographs, one for four other characters; at least one for any text, 0 for none."""
    han = F.length(text) - F.length(F.regexp_replace(text, "[\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]", ""))
    other = F.greatest(F.lit(1), F.floor((F.length(text) - han) / 4))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.floor(han / 1.5) + other).cast("long")


def quarter_tokens(text: Column) -> Column:
    """One token for four characters, at least one; 0 for null."""
    return F.coalesce(F.greatest(F.lit(1), F.floor(F.length(text) / 4)), F.lit(0)).cast("long")


def _not_stopword(word: Column) -> Column:
    return ~word.isin(*fixed.STOPWORDS)


def index_tokens(text: Column) -> Column:
    """Lower-case identifiers of two or more characters without stop words, repeated ones kept."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), F.lower)
    return F.coalesce(F.filter(words, _not_stopword), F.array().cast("array<string>"))


def query_terms(text: Column) -> Column:
    """Identifiers of three or more characters without stop words, each once in any letter case, first spelling kept."""
    words = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)), lambda w: _not_stopword(F.lower(w)))
    pair = lambda ws: let(F.transform(ws, F.lower), lambda low: F.filter(ws, lambda w, i: F.array_position(low, F.lower(w)) == i + 1))
    return let(words, pair)


def identifier_parts(name: Column) -> Column:
    """camelCase and snake_case names cut into index tokens."""
    s = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return index_tokens(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns occurs."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def begins(line: Column, patterns: Sequence[str]) -> Column:
    """Whether a line, surrounding space aside, begins with one of the patterns."""
    return matches(line, [rf"^\s*(?:{p})" for p in patterns])


def intent(text: Column) -> Column:
    found = F.lit(fixed.DEFAULT_INTENT)
    for name, patterns in reversed(fixed.INTENTS.items()):
        found = F.when(matches(text, patterns), name).otherwise(found)
    return found


def query_type(text: Column) -> Column:
    """The one type whose words occur; none or several read as MEMORY."""
    hits = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in fixed.QUERY_TYPES.items()]), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 1, hits[0]).otherwise(fixed.DEFAULT_QUERY_TYPE)


def clean_query(text: Column) -> Column:
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), fixed.QUERY_NOISE, text))


def script_language(text: Column) -> Column:
    """ja for kana, zh-CN for ideographs, ko and ru for at least two and a tenth of all visible characters, else en."""
    count = lambda cls: F.regexp_count(text, F.lit(cls))
    seen = F.greatest(count(r"\S"), F.lit(1))
    share = lambda cls: (count(cls) >= 2) & (count(cls) / seen >= 0.1)
    return (
        F.when(text.rlike("[\\x{3040}-\\x{30ff}]"), "ja")
        .when(text.rlike("[\\x{4e00}-\\x{9fff}]"), "zh-CN")
        .when(share("[\\x{ac00}-\\x{d7af}]"), "ko")
        .when(share("[\\x{0400}-\\x{04ff}]"), "ru")
        .otherwise("en")
    )


def routing_key(key: Column, category: Column) -> Column:
    """Lower case, underscores for spaces and hyphens, synonyms led to one name; the category where there is no key."""
    s = F.regexp_replace(F.translate(F.trim(F.lower(key)), " -", "__"), "_+", "_")
    table = F.create_map(*[F.lit(x) for group in fixed.SYNONYMS for name in group for x in (name, group[0])])
    return F.when(F.coalesce(key, F.lit("")) == "", category).otherwise(F.coalesce(table[s], s))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.trim(F.lower(text)), r"\s+", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_-]", ""), "-+", "-"), "^-|-$", "")


def fit_length(text: Column, most: int) -> Column:
    """Texts up to ``most`` characters pass, up to a tenth more are cut with dots, longer ones become null."""
    n = F.length(text)
    return F.when(n <= most, text).when(n <= int(most * 1.1), F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def html_escape(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def error_key(text: Column) -> Column:
    s = F.regexp_replace(text, r'File\s+"[^"\n]*",\s+line\s+\d+', 'File "...", line <N>')
    return F.regexp_replace(F.regexp_replace(s, "0x[0-9a-fA-F]+", "<ADDR>"), r"\berrno\s*[=:]\s*\d+", "errno=<N>")


def warning_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\d+\.\d+", "<VER>"), r"/[^\s]+", "<PATH>")


def content_type(text: Column) -> Column:
    """ERROR, CODE, LOG, MEMORY or GENERIC by how many kinds of telling patterns occur (the last three in 20 lines); three
    lines that begin as log lines do make a LOG, too."""
    some = lambda col, patterns: reduce(lambda a, b: a + b, [col.rlike(p).cast("int") for p in patterns])
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 20), "\n")
    errors, code, logs, notes = (fixed.CONTENT_PATTERNS[k] for k in ("ERROR", "CODE", "LOG", "MEMORY"))
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < 10, "GENERIC")
        .when(some(text, errors) >= 2, "ERROR")
        .when(some(head, code) >= 3, "CODE")
        .when((some(head, logs) >= 2) | (F.regexp_count(head, F.lit(fixed.LOG_PREFIX)) >= 3), "LOG")
        .when(some(head, notes) >= 2, "MEMORY")
        .otherwise("GENERIC")
    )


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_language(path: Column, hint: Column) -> Column:
    """The hint in lower case, else what the extension says, else unknown."""
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    return F.coalesce(F.when(hint != "", F.trim(F.lower(hint))), table[extension(path)], F.lit("unknown"))


def is_code_path(path: Column) -> Column:
    """A relative path with a code extension outside ignored folders; a backslash separates, too. Null is no code path."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")
    parts = F.split(p, "/")
    ignored = F.exists(parts, lambda x: x.isin(*fixed.IGNORED_FOLDERS) | x.startswith(fixed.IGNORED_FOLDER_PREFIX))
    suffix = F.lower(F.regexp_extract(p, r"[^/]\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(suffix.isin(*fixed.CODE_EXTENSIONS) & ~ignored & ~F.array_contains(parts, "..") & ~p.startswith("/"), F.lit(False))


def pattern_words(pattern: Column) -> Column:
    """The words of a search pattern without its operators, at most 1,500 characters."""
    s = F.regexp_replace(F.regexp_replace(pattern, r"\(\?:[^)]*\)", " "), r"\\.", " ")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(s, r"[|()?+*]", " "), r"\s+", " ")), 1, 1500)


def relative_path(path: Column) -> Column:
    """What follows /workspace/, else the last two parts."""
    inside = F.ltrim(F.lit("/"), F.substring_index(path, "/workspace/", -1))
    return F.when(path.contains("/workspace/"), inside).otherwise(F.regexp_extract(path, "([^/]+/)?[^/]+$", 0))


def with_location(content: Column, path: Column, first: Column, last: Column) -> Column:
    """The content under a line that names path and line range; the same once more changes nothing."""
    lines = F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit(" (lines "), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"))).otherwise("")
    head = F.concat(F.lit("# "), relative_path(path), lines, F.lit("\n\n"))
    body = F.coalesce(content, F.lit(""))
    return F.when(body.startswith(head), body).otherwise(F.concat(head, body))


def record_id(uri: Column, level: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", uri, level.cast("string")), 256), 1, 16)


def parent_uri(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, "/+$", ""), "[^/]+$", "")


def uri_parts(uri: Column) -> Column:
    """account, scope (users, agents or resources), owner and rest of a ``ctx://`` address; null where it is none."""
    p = F.regexp_extract
    pattern = r"^ctx://([^/]+)/(users|agents|resources)(?:/([^/]+))?(?:/(.*))?$"
    good = uri.rlike(pattern)
    return F.when(good, F.struct(*[p(uri, pattern, i).alias(n) for i, n in enumerate(("account", "scope", "owner", "rest"), 1)]))


def hotness(count: Column, updated: Column, now: Column, half_life_days: float = 7.0) -> Column:
    """log1p(n) / (log1p(n) + 1), halved every ``half_life_days``; 0 without a time; a time ahead counts as now."""
    c = F.log1p(F.coalesce(count, F.lit(0)).cast("double"))
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / 86_400_000_000.0)
    return F.coalesce(c / (c + 1) * F.exp(-F.log(F.lit(2.0)) * days / half_life_days), F.lit(0.0))


def backoff_ms(retries: Column) -> Column:
    return F.least(F.lit(60_000.0), 1000 * F.pow(F.lit(2.0), retries)).cast("long")


def hash_vector(text: Column, dimensions: int = 384) -> Column:
    """A stand-in embedding: byte i of sha256(text), taken cyclically, as (byte - 128) / 128."""
    octet = lambda h, i: F.conv(F.substring(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double")
    return let(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (octet(h, i) - 128) / 128))
