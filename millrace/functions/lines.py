"""Column functions on texts seen as arrays of lines: condensing without leaving the row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.functions import text as T


def lines(text: Column) -> Column:
    """The lines of a text; every kind of line end counts, and a last line end opens no further line."""
    s = F.regexp_replace(F.regexp_replace(text, "\r\n|[\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]", "\n"), "\n$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(s, "\n"))


def runs(text: Column, most: int = 3) -> Column:
    """Runs of equal lines (surrounding space aside) longer than ``most`` become one line and a marker; shorter runs
    repeat their first line; runs of blank lines become one blank line, and none at the start."""

    def show(L: Column, trimmed: Column, begins: Column) -> Column:
        def run(b: Column, k: Column) -> Column:
            n, t = F.coalesce(F.get(begins, k + 1), F.size(L) + 1) - b, F.element_at(trimmed, b)
            return (
                F.when(t == "", F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(""))))
                .when(n > most, F.array(t, F.concat(F.lit("[repeated "), n.cast("string"), F.lit(" times]"))))
                .otherwise(F.array_repeat(F.element_at(L, b), n))
            )

        return F.array_join(F.flatten(F.transform(begins, run)), "\n")

    def begins(t: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))

    whole = T.let(lines(text), lambda L: T.let(F.transform(L, lambda x: F.trim(x)), lambda t: T.let(begins(t), lambda b: show(L, t, b))))
    return F.when(text == "", text).otherwise(whole)


def head_tail(text: Column, most: int, tail: int = 10) -> Column:
    """The first and last lines of a text of more than ``most`` lines, with a marker that tells how many are gone."""
    head = min(most // 2, most - tail)

    def cut(L: Column) -> Column:
        marker = F.concat(F.lit("... ["), (F.size(L) - head - tail).cast("string"), F.lit(" lines left out] ..."))
        kept = F.concat(F.slice(L, 1, head), F.array(marker), F.slice(L, F.size(L) - tail + 1, tail))
        return F.when(F.size(L) <= most, text).otherwise(F.array_join(kept, "\n"))

    return T.let(lines(text), cut)


def critical_first(text: Column, most: int) -> Column:
    """A third from the start, a third from the end, and between them the first telling lines while there is room."""
    third = most // 3

    def cut(L: Column) -> Column:
        middle = F.slice(L, third + 1, F.greatest(F.size(L) - 2 * third, F.lit(0)))
        telling = F.slice(F.filter(middle, lambda x: T.begins(x, fixed.CRITICAL_LINE)), 1, most - 2 * third)
        return F.when(F.size(L) <= most, text).otherwise(F.array_join(F.concat(F.slice(L, 1, third), telling, F.slice(L, F.size(L) - third + 1, third)), "\n"))

    return T.let(lines(text), cut)


def _is_error(x: Column) -> Column:
    return T.matches(x, fixed.ERROR_ANYWHERE)


def _is_warning(x: Column) -> Column:
    return T.let(F.lower(x), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in fixed.WARNING_WORDS]))


def _telling(rows: Column, test: Callable[[Column], Column], most: int) -> Column:
    return F.slice(F.transform(F.filter(rows, test), lambda x: F.trim(x)), 1, most)


def error_lines(text: Column, most: int = 10) -> Column:
    return _telling(lines(text), _is_error, most)


def warning_lines(text: Column, most: int = 10) -> Column:
    return _telling(lines(text), _is_warning, most)


def summary(text: Column, most: int = 50) -> Column:
    """Head lines, at most five error and five warning lines, and a quarter (rounded up) from the end."""
    tail = -(-most // 4)

    def cut(L: Column) -> Column:
        parts = F.concat(F.slice(L, 1, most // 2), _telling(L, _is_error, 5), _telling(L, _is_warning, 5), F.slice(L, F.size(L) - tail + 1, tail))
        return F.when(F.size(L) <= most, text).otherwise(F.array_join(parts, "\n"))

    return T.let(lines(text), cut)


def count_lines(text: Column, patterns: Sequence[str]) -> Column:
    """How many lines begin with one of the patterns."""
    return F.size(F.filter(lines(text), lambda x: T.begins(x, patterns)))


def drop_lines(text: Column, drop: str, keep: str = "(?!)") -> Column:
    """Without the lines that match ``drop``, unless they match ``keep``."""
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(drop) | x.rlike(keep)), "\n")


def distinct_warnings(text: Column) -> Column:
    """Each warning line once for its key (versions and paths aside); all other lines stay."""
    key = lambda x: F.when(T.begins(x, fixed.WARNING_LINE), T.warning_key(F.trim(x)))
    first = lambda L, keys: F.filter(L, lambda x, i: F.get(keys, i).isNull() | (F.array_position(keys, F.get(keys, i)) == i + 1))
    return T.let(lines(text), lambda L: T.let(F.transform(L, key), lambda keys: F.array_join(first(L, keys), "\n")))
