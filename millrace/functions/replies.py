"""Column functions on what an agent answers: its kind, and keywords by which it is remembered. Null reads as generic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import lines as L
from millrace.functions import text as T


def reply_kind(text: Column) -> Column:
    """patch, tool_call, error, reasoning, code or generic; the first that fits."""
    head = F.substring(text, 1, 500)
    patch = text.rlike(r"(?m)^--- a/") | text.rlike(r"(?m)^\+\+\+ b/") | text.contains("diff --git")
    call = text.contains("<tool_call>") | head.contains("Calling tool:") | (head.contains('"name":') & head.contains('"arguments":'))
    error = text.contains("Traceback (most recent call last)") | (head.rlike(r"\b(Error|Exception|Failed|failed|error|SEVERE)\b") & (F.length(text) > 200))
    reasoning = T.matches(head, fixed.REASONING) & (F.length(text) > 500)
    kind = F.when(patch, "patch").when(call, "tool_call").when(error, "error").when(reasoning, "reasoning").when(T.content_type(text) == "CODE", "code")
    return kind.otherwise("generic")


def patch_words(text: Column) -> Column:
    """The first five of the files a patch names, in order of name."""
    names = F.array_union(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (r"(?m)^--- a/(\S+)", r"(?m)^\+\+\+ b/(\S+)")])
    return F.concat_ws(",", F.lit("patch"), F.slice(F.array_sort(names), 1, 5))


def error_words(text: Column) -> Column:
    """The type of the first error line among fifteen and the beginning of its message."""
    first = F.get(F.filter(F.slice(L.lines(text), 1, 15), lambda x: x.rlike(r"(?i)\b(Error|Exception|Failed|SEVERE|FATAL)\b")), F.lit(0))
    part = lambda g: F.regexp_extract(F.trim(first), r"^(\w+Error|\w+Exception|\w+Failed|Error|Exception|Failed):\s*(.*)", g)
    told = F.array(part(1), F.substring(part(2), 1, 50))
    return F.concat_ws(",", F.lit("error"), F.filter(told, lambda x: x != ""))


def reasoning_words(text: Column) -> Column:
    """The first three steps among twenty lines, and the first telling one of the last five lines."""

    def pick(rows: Column) -> Column:
        mark = r"^\s*(\d+\.|Step \d+|#\s|\-\s+)\s*"
        told = lambda x: F.trim(F.regexp_replace(x, mark, ""))
        steps = F.filter(F.transform(F.filter(F.slice(rows, 1, 20), lambda x: x.rlike(mark)), told), lambda x: F.length(x) > 3)
        last = F.filter(F.transform(F.slice(rows, F.greatest(F.size(rows) - 4, F.lit(1)), 5), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
        return F.transform(F.concat(F.slice(steps, 1, 3), F.slice(last, 1, 1)), lambda x: F.substring(x, 1, 40))

    return F.concat_ws(",", F.lit("reasoning"), T.let(L.lines(text), pick))


def call_words(text: Column) -> Column:
    """The tool a call names, in one of three notations."""
    names = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"<name>(\w+)</name>", r'"name":\s*"(\w+)"', r"Calling tool:\s*(\w+)")]
    return F.concat_ws(",", F.lit("tool_call"), F.coalesce(*names))


def code_words(text: Column) -> Column:
    """The first five definitions and decorators among thirty lines."""
    definition, decorator = r"^\s*(?:async\s+)?(def|class)\s+(\w+)", r"^\s*@(\w+)"
    name = lambda x: F.when(x.rlike(definition), F.concat(F.regexp_extract(x, definition, 1), F.lit(":"), F.regexp_extract(x, definition, 2))).when(x.rlike(decorator), F.concat(F.lit("decorator:"), F.regexp_extract(x, decorator, 1)))
    found = F.filter(F.transform(F.slice(L.lines(text), 1, 30), name), lambda x: x.isNotNull())
    return F.concat_ws(",", F.lit("code"), F.slice(found, 1, 5))


def generic_words(text: Column) -> Column:
    """The longer words that begin the first telling one of five lines, and the first abbreviation of each of twenty lines, up to four in all."""

    def pick(rows: Column) -> Column:
        first = F.get(F.filter(F.transform(F.slice(rows, 1, 5), lambda x: F.trim(x)), lambda x: F.length(x) > 5), F.lit(0))
        words = F.filter(F.slice(F.split(first, r"\s+"), 1, 5), lambda w: F.length(w) > 2)
        phrase = F.substring(F.array_join(words, " "), 1, 50)
        known = lambda x: F.get(F.filter(F.regexp_extract_all(x, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), lambda w: ~w.isin(*fixed.COMMON_ABBREVIATIONS)), F.lit(0))
        short = F.filter(F.transform(F.slice(rows, 1, 20), known), lambda x: x.isNotNull())
        return F.slice(F.concat(F.filter(F.array(phrase), lambda x: x != ""), short), 1, 3)

    return F.concat_ws(",", F.lit("generic"), T.let(L.lines(text), pick))


WORDS = {"patch": patch_words, "tool_call": call_words, "error": error_words, "reasoning": reasoning_words, "code": code_words, "generic": generic_words}


def reply_words(text: Column) -> Column:
    """The keywords of an answer by its kind."""
    by_kind = lambda kind: reduce(lambda out, item: out.when(kind == item[0], item[1](text)), list(WORDS.items())[1:], F.when(kind == "patch", patch_words(text)))
    return T.let(reply_kind(text), by_kind)
