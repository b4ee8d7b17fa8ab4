"""Column functions on the outputs of commands and on prompts: what they are, what can go, what they are about.

Null stays null unless a default is named.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import lines as L
from millrace.functions import text as T


def _has(line: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [line.contains(w) for w in words])


def output_kind(text: Column) -> Column:
    """test, build, log, json or generic, by the words of the first ten lines."""
    head = F.lower(F.array_join(F.slice(L.lines(text), 1, 10), "\n"))
    kind = F.when(F.ltrim(text).rlike(r"^\s*[{\[]"), "json").otherwise("generic")
    for name, words in reversed(fixed.OUTPUT_WORDS.items()):
        kind = F.when(_has(head, words), name).otherwise(kind)
    return F.when(text.isNotNull(), kind)


def dropped(text: Column, drop: Sequence[str], keep: Sequence[str], what: str) -> Column:
    """Without the lines that match ``drop`` and not ``keep``; a last line tells how many went."""

    def cut(rows: Column) -> Column:
        kept = F.filter(rows, lambda x: T.matches(x, keep) | ~T.matches(x, drop))
        told = F.concat(F.lit(f"... [{what}: "), (F.size(rows) - F.size(kept)).cast("string"), F.lit(" lines left out]"))
        return F.array_join(F.when(F.size(kept) < F.size(rows), F.concat(kept, F.array(told))).otherwise(kept), "\n")

    return T.let(L.lines(text), cut)


def without_install_progress(text: Column) -> Column:
    return dropped(text, fixed.INSTALL_DROP, fixed.INSTALL_KEEP, "install progress")


def without_access_log(text: Column) -> Column:
    """Lines of an access log go, unless they tell of an error of the server."""
    return dropped(text, fixed.ACCESS_DROP, fixed.ACCESS_KEEP, "access log")


def compact_test(text: Column) -> Column:
    """At most 20 result lines and 10 error lines of a test run, and how many of them passed and failed."""

    def fold(rows: Column) -> Column:
        low = F.transform(rows, lambda x: F.lower(x))
        passed = lambda x: x.contains("passed") | x.rlike(r"^\s*(passed|ok|pass)\s+\d+")
        failed = lambda x: ~passed(x) & (x.contains("failed") | x.rlike(r"^\s*(failed|fail|failure)\s+\d+"))
        error = lambda x: ~passed(x) & ~failed(x) & (x.contains("error") | x.contains("traceback"))
        count = lambda f: F.size(F.filter(low, f))
        pick = lambda f, n: F.slice(F.transform(F.filter(rows, lambda x: f(F.lower(x))), lambda x: F.trim(x)), 1, n)
        errors = pick(error, 10)
        head = F.when(F.size(errors) > 0, F.array(F.lit("Errors:"))).otherwise(F.array().cast("array<string>"))
        summary = F.when(count(passed) + count(failed) > 0, F.array(F.concat(count(passed).cast("string"), F.lit(" passed, "), count(failed).cast("string"), F.lit(" failed")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(pick(lambda x: passed(x) | failed(x), 20), head, errors, summary), "\n")

    return T.let(L.lines(text), fold)


def compact_build(text: Column) -> Column:
    """The first 15 lines of a build, 5 lines with errors or warnings, and the last 10 of a longer one."""

    def cut(rows: Column) -> Column:
        none = F.array().cast("array<string>")
        errors = F.slice(F.filter(rows, lambda x: F.lower(x).contains("error") | F.lower(x).contains("warning:")), 1, 5)
        tail = F.when(F.size(rows) > 15, F.concat(F.array(F.lit("---")), F.slice(rows, F.greatest(F.size(rows) - 9, F.lit(1)), 10))).otherwise(none)
        marked = F.when(F.size(errors) > 0, F.concat(F.array(F.lit("--- errors and warnings")), errors)).otherwise(none)
        return F.array_join(F.concat(F.slice(rows, 1, 15), marked, tail), "\n")

    return T.let(L.lines(text), cut)


def compact_json(text: Column) -> Column:
    """The keys that begin the first 30 lines of a JSON text, and how many lines follow."""

    def keys(rows: Column) -> Column:
        named = F.transform(F.filter(F.transform(F.slice(rows, 1, 30), lambda x: F.trim(x)), lambda x: x.startswith('"')), lambda x: F.concat(F.lit("  "), F.split(x, '"')[1], F.lit(": ...")))
        more = F.when(F.size(rows) > 30, F.array(F.concat(F.lit("  ... ["), (F.size(rows) - 30).cast("string"), F.lit(" more lines]")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.array(F.lit("{")), named, more, F.array(F.lit("}"))), "\n")

    return T.let(L.lines(text), keys)


def compact_log(text: Column) -> Column:
    """Runs of more than two equal lines folded, then at most 80 lines."""
    return T.let(L.runs(text, 2), lambda t: L.head_tail(t, 80))


def compacted(text: Column) -> Column:
    """An output condensed by the rule of its kind; generic ones to 60 lines."""
    forms = {"test": compact_test, "build": compact_build, "json": compact_json, "log": compact_log}

    def form(kind: Column) -> Column:
        out = T.let(L.runs(text), lambda t: L.head_tail(t, 60))
        for name, f in forms.items():
            out = F.when(kind == name, f(text)).otherwise(out)
        return out

    return T.let(output_kind(text), form)


def without_comments(text: Column) -> Column:
    """Without lines that hold only a comment, with no space at line ends."""
    kept = F.filter(F.transform(L.lines(text), lambda x: F.rtrim(x)), lambda x: ~x.rlike(r"^\s*(?:#|//|--)"))
    return F.array_join(kept, "\n")


# mode: (drop comments, distinct warnings, most lines by head and tail, lines of the tail, most lines by summary)
MODES = {
    "code": (True, False, 80, 15, None),
    "log": (False, False, None, 10, 100),
    "generic": (True, False, 60, 10, 60),
    "memory": (True, True, None, 10, 40),
}


def shortened(text: Column, mode: str) -> Column:
    """The stages of a mode one after the other: comments, repeated lines, head and tail, summary."""
    comments, warnings, most, tail, summary = MODES[mode]
    stages = [without_comments] * comments + [lambda t: L.runs(t)] + [L.distinct_warnings] * warnings
    stages += [lambda t: L.head_tail(t, most, tail)] * bool(most) + [lambda t: L.summary(t, summary)] * bool(summary)
    return reduce(T.let, stages, text)  # each stage takes the text of the one before as a value


def adaptive(text: Column) -> Column:
    """``struct(kind, text, ratio)``: shortened by the mode that fits the content type."""
    mode = lambda k: F.when(k == "CODE", shortened(text, "code")).when(k.isin("LOG", "ERROR"), shortened(text, "log")).when(k == "MEMORY", shortened(text, "memory")).otherwise(shortened(text, "generic"))
    found = T.let(T.content_type(text), lambda k: F.struct(k.alias("kind"), mode(k).alias("text")))
    ratio = lambda s: F.when(F.length(text) > 0, F.length(s["text"]) / F.length(text)).otherwise(1.0)
    return T.let(found, lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), ratio(s).alias("ratio")))


def command_word(command: Column) -> Column:
    """The program a command calls: its first word that sets no variable, without a folder."""
    words = F.filter(F.split(F.trim(command), r"\s+"), lambda w: ~w.rlike(r"^[A-Za-z_]\w*=") & (w != ""))
    return F.substring_index(F.get(words, F.lit(0)), "/", -1)


def command_output(command: Column, output: Column, expected: Column) -> Column:
    """test_runner, diff, python_error or empty, by what was expected of the command and what its output shows."""
    diff = output.rlike(r"(?m)^diff --git a/") | output.rlike(r"(?m)^@@\s+-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@")
    error = output.rlike(r"Traceback \(most recent call last\)|\b\w*(Error|Exception):")
    return (
        F.when(expected.isin("test_runner", "diff"), expected)
        .when(expected == "diff_maybe", F.when(diff, "diff").otherwise(""))
        .when(expected == "python_maybe", F.when(error, "python_error").otherwise(""))
        .when(F.lower(command).rlike(r"(^|[\s;&|()])git\s+diff\b"), "diff")
        .otherwise("")
    )


@dataclass(frozen=True)
class Profile:
    """Outputs that one shortener fits: programs, categories, patterns and extensions that tell of them."""

    name: str
    shortener: str
    commands: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    priority: int = 0


BY_COMMAND, BY_CATEGORY, BY_PATTERN, BY_EXTENSION, LEAST = 100, 80, 50, 30, 30  # fixed values


def routed(text: Column, command: Column, path: Column, category: Column, profiles: Sequence[Profile]) -> Column:
    """``struct(score, priority, place, name, shortener)`` of the profile that fits best, or null where none reaches the least
    score; of equal ones the higher priority, then the one named first. Profiles are a list of one's own, not a table."""
    said, end = command_word(command), T.extension(path)
    point = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    def fit(place: int, p: Profile) -> Column:
        score = point(said.isin(*p.commands), BY_COMMAND) + point(category.isin(*p.categories), BY_CATEGORY) + point(end.isin(*p.extensions), BY_EXTENSION)
        score = score + (point(T.matches(text, p.patterns), BY_PATTERN) if p.patterns else F.lit(0))
        return F.struct(score.alias("score"), F.lit(p.priority).alias("priority"), F.lit(-place).alias("place"), F.lit(p.name).alias("name"), F.lit(p.shortener).alias("shortener"))

    return F.array_max(F.filter(F.array(*[fit(i, p) for i, p in enumerate(profiles)]), lambda x: x["score"] >= LEAST))


def prompt_keywords(text: Column) -> Column:
    """The intents a prompt shows, comma between; without one three of its first five words; else ``general``; empty for a blank text."""
    none = F.lit(None).cast("string")
    found = F.filter(F.array(*[F.when(T.matches(text, p), F.lit(n)).otherwise(none) for n, p in fixed.PROMPT_INTENTS.items()]), lambda x: x.isNotNull())
    words = F.slice(F.filter(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, 5), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$")), 1, 3)
    plain = F.when(F.size(words) > 0, F.array_join(words, ",")).otherwise(fixed.DEFAULT_PROMPT_INTENT)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "").when(F.size(found) > 0, F.array_join(found, ",")).otherwise(plain)


def prompt_topic(text: Column) -> Column:
    """What a prompt is about, by two patterns; a topic of up to two characters leaves it to the second; null without one."""
    topics = [F.regexp_extract(text, p, g) for p, g in fixed.PROMPT_TOPIC]
    return F.coalesce(*[F.when(F.length(t) > 2, t) for t in topics])
