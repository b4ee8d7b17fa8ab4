"""Column functions on names, addresses and the small texts built from them. Null stays null unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as T

SCOPE_WORDS, SLUG = 24, 96  # fixed values: words of a query's scope, characters of a slug before its digest


def identity(text: Column) -> Column:
    """Lower case, one underscore for each run of other characters than letters and digits; ``code_chunk`` where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.lower(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "code_chunk").otherwise(s)


def code_slug(language: Column, path: Column, symbol: Column, first: Column, last: Column) -> Column:
    """A readable name of a chunk, cut at 96 characters, and sixteen digits of the hash of what identifies it."""
    lang, file, name = F.coalesce(language, F.lit("unknown")), F.coalesce(path, F.lit("")), F.coalesce(F.nullif(symbol, F.lit("")), F.lit("symbol"))
    known = first.isNotNull() & last.isNotNull()
    span = lambda sep: F.when(known, F.concat(first.cast("string"), F.lit(sep), last.cast("string"))).otherwise(f"0{sep}0")
    base = F.substring_index(file, "/", -1)
    stem = F.when(file == "", "file").when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    head = F.regexp_replace(F.substring(identity(F.concat_ws("_", lang, stem, name, span("_"))), 1, SLUG), "_+$", "")
    whole = F.concat_ws(":", lang, file, name, span("-"))
    return F.concat_ws("_", F.when(head == "", "code_chunk").otherwise(head), F.substring(F.sha1(whole), 1, 16))


def folder_of(uri: Column) -> Column:
    """Where a ``ctx://`` address lies: /accounts/, the account, and the rest with a slash at its end; null for what is no such address."""
    pattern = r"^ctx://([^/]+)/((?:users|agents)/[^/]+/memories(?:/[^/]+){0,2}|agents/[^/]+/skills/[^/]+|sessions/[^/]+/history(?:/[^/]+)?)/*$"
    return F.when(uri.rlike(pattern), F.concat(F.lit("/accounts/"), F.regexp_extract(uri, pattern, 1), F.lit("/"), F.try_url_decode(F.regexp_extract(uri, pattern, 2)), F.lit("/")))


def path_question(path: Column, intent: Column) -> Column:
    """A question for a file: the intent, or name and path, and the spellings of the path that it does not hold yet."""
    q, asked = F.trim(F.translate(F.coalesce(path, F.lit("")), "\\", "/")), F.trim(F.coalesce(intent, F.lit("")))
    name = F.substring_index(q, "/", -1)
    base = F.when(asked != "", asked).otherwise(F.concat_ws(" ", name, q))
    spelled = F.array(F.translate(q, "/.", "__"), F.translate(name, ".", "_"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    return F.when(q == "", asked).otherwise(T.let(base, lambda b: F.concat_ws(" ", b, F.filter(spelled, lambda t: (t != "") & ~F.array_contains(F.split(b, r"\s+"), t)))))


def scoped_question(query: Column, hints: Column) -> Column:
    """A question and, on a second line, up to 24 distinct words of its hints (an array of terms and patterns)."""
    words = F.slice(F.array_distinct(F.flatten(F.transform(hints, T.identifier_parts))), 1, SCOPE_WORDS)
    scope = F.when(F.size(words) > 0, F.concat(F.lit("scope: "), F.array_join(words, " ")))
    return F.concat_ws("\n", F.nullif(F.trim(query), F.lit("")), scope)


def hints(text: Column) -> Column:
    """The distinct items of a list with commas or line ends between them; none for null."""
    items = F.filter(F.transform(F.split(text, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.array_distinct(items), F.array().cast("array<string>"))


def newest(text: Column, most: int) -> Column:
    """The last ``most`` characters; empty for null."""
    return F.coalesce(F.right(text, F.lit(most)), F.lit(""))


def inside(path: Column, roots: Sequence[str]) -> Column:
    """A path relative to the first of the roots that holds it; empty where none does."""
    found = F.lit("")
    for r in reversed([r.rstrip("/") for r in roots]):
        found = F.when(path == r, ".").when(path.startswith(r + "/"), F.substring(path, len(r) + 2, 1 << 30)).otherwise(found)
    return found


def looks_like_path(line: Column) -> Column:
    """Whether a line has a slash, or a dot."""
    return F.coalesce(line.contains("/") | line.contains("."), F.lit(False))


def some_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text, counted from 1."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def last_occurrence(rows: Column, part: Column) -> Column:
    """Where an array occurs as a run inside another for the last time, counted from 0; -1 where it does not, or is empty."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(rows) - F.size(part), F.lit(0))), lambda i: F.slice(rows, i + 1, F.size(part)) == part)
    return F.when((F.size(part) > 0) & (F.size(part) <= F.size(rows)), F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1))).otherwise(-1)


def vector_literal(vector: Column) -> Column:
    """A vector as text in brackets, eight digits behind the point."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", F.bround(x.cast("double"), 8))), ","), F.lit("]"))


def flat(fields: dict[str, Column]) -> Column:
    """A map of texts without the fields that are null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def seeded_vector(text: Column, dimensions: int = 16) -> Column:
    """A stand-in embedding: x -> (1103515245 x + 12345) mod 2^31 from the md5 of a text, brought to -1..1.

    Only the last 31 bits of the hash matter, as all that lies above is a multiple of 2^31."""
    seed = F.conv(F.substring(F.md5(text), 25, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    step = lambda x: (x * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF))
    states = F.aggregate(
        F.sequence(F.lit(1), F.lit(dimensions)), F.struct(seed.alias("x"), F.array().cast("array<long>").alias("all")),
        lambda s, _: T.let(step(s["x"]), lambda n: F.struct(n.alias("x"), F.array_append(s["all"], n).alias("all"))),
    )
    return F.transform(states["all"], lambda x: x / F.lit(float(0x7FFFFFFF)) * 2 - 1)


def part_name(pattern: str, channel: Column, at: Column, index: Column) -> Column:
    """The file name of a part: {channel} {timestamp} {date} {time} {datetime} {index} of a pattern filled in."""
    stamp = lambda f: F.date_format(at, f)
    fills = {"{channel}": channel, "{timestamp}": F.unix_seconds(at).cast("string"), "{datetime}": stamp("yyyyMMdd_HHmmss"), "{date}": stamp("yyyyMMdd"), "{time}": stamp("HHmmss"), "{index}": F.lpad(index.cast("string"), 6, "0")}
    return reduce(lambda c, item: F.replace(c, F.lit(item[0]), item[1]), fills.items(), F.lit(pattern))
