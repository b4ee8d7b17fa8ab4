"""Shorteners for tool output whose rules run line by line with state: diffs, histories, steps, blocks.

Each is a plain function on one text; ``shortened`` makes it a column function over Arrow batches, or takes that of the JVM where there is one. Null stays null,
and a text that holds nothing of the kind comes back as it is, without a look at its lines where a search tells.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _more(n: int, what: str = "lines") -> str:
    return f"... [{n} more {what}]"


def diff_context(text: str, around: int = 3) -> str:
    """Changed lines with ``around`` lines on either side, and all headers; each gap becomes one marker."""
    if not (text.startswith(("+", "-")) or "\n+" in text or "\n-" in text):
        return text
    rows = text.split("\n")
    head = re.compile(r"(?:diff |index |--- |\+\+\+ |@@ )")
    changed = [bool(re.match(r"[+-]", r)) and not re.match(r"---|\+\+\+", r) for r in rows]
    if not any(changed):
        return text
    near = [0] * (len(rows) + 1)
    for i, c in enumerate(changed):
        if c:
            near[max(0, i - around)] += 1
            near[min(len(rows), i + around + 1)] -= 1
    out, gap, level = [], 0, 0
    for r, step in zip(rows, near):
        level += step
        if level or head.match(r):
            if gap:
                out.append(_more(gap))
            out.append(r)
            gap = 0
        else:
            gap += 1
    return "\n".join(out + [_more(gap)] * bool(gap))


def patch_hunks(text: str, most: int = 3) -> str:
    """For each file of a patch its headers and first ``most`` hunks."""
    if "@@" not in text:
        return text
    out, hunks, left = [], 0, 0
    for r in [*text.split("\n"), None]:
        new_file = r is None or re.match(r"diff --git |--- ", r) is not None and hunks > 0
        if new_file and left:
            out.append(_more(left, "hunks"))
        if new_file:
            hunks = left = 0
        if r is None:
            break
        if r.startswith("@@"):
            hunks += 1
            left += hunks > most
        if hunks <= most:
            out.append(r)
    return "\n".join(out)


def history(text: str, most: int = 10, hint: int = 60) -> str:
    """A commit log as one line a commit: short id, subject, and the beginning of what follows."""
    if "commit " not in text:
        return text
    commits = re.split(r"(?m)^commit (?=[0-9a-f]{7,40}\b)", text)
    if len(commits) < 2:
        return text
    out = []
    for c in commits[1:]:
        ident, _, body = c.partition("\n")
        told = [r.strip() for r in body.split("\n") if r.startswith("    ") and r.strip()]
        rest = " ".join(told[1:])[:hint]
        out.append(f"{ident[:8]} {told[0] if told else ''}" + (f" | {rest}" if rest else ""))
    return "\n".join(out[:most] + [_more(len(out) - most, "commits")] * (len(out) > most))


def work_tree(text: str) -> str:
    """Two-letter status lines grouped into staged, modified and untracked paths."""
    groups: dict[str, list[str]] = defaultdict(list)
    for x, y, path in re.findall(r"(?m)^([ MADRCU?])([ MADRCU?]) (\S.*)$", text):
        if x + y == "??":
            groups["untracked"].append(path)
        else:
            if x != " ":
                groups["staged"].append(path)
            if y != " ":
                groups["modified"].append(path)
    return "\n".join(f"{k} ({len(groups[k])}): {', '.join(groups[k])}" for k in ("staged", "modified", "untracked") if groups[k]) or text


def steps(text: str, first: int = 3, last: int = 2) -> str:
    """Numbered or 'Step n' lines with what follows them: the first and last ones, a marker between."""
    parts = re.split(r"(?m)^(?=[^\S\n]*(?:Step\s+\d+|\d+[.)])\s)", text)
    if len(parts) - 1 <= first + last:
        return text
    body = parts[1:]
    return "".join([parts[0], *body[:first], _more(len(body) - first - last, "steps") + "\n", *body[-last:]])


def error_report(text: str, first: int = 5, last: int = 3) -> str:
    """What stands before a trace, its first and last lines, and the line that names the error."""
    rows = text.split("\n")
    at = next((i for i, r in enumerate(rows) if r.startswith("Traceback (most recent call last)")), None)
    if at is None:
        return text
    end = next((i for i in range(at + 1, len(rows)) if rows[i] and not rows[i].startswith((" ", "\t"))), len(rows) - 1)
    trace = rows[at:end]
    if len(trace) > first + last:
        trace = trace[:first] + [_more(len(trace) - first - last)] + trace[-last:]
    return "\n".join(rows[:at] + trace + rows[end:])


def long_blocks(text: str, most: int = 15, head: int = 8, tail: int = 3, opens: str = r"^\s*\S.*[\[{(]\s*$") -> str:
    """Blocks from an opening line to a blank line or the closing bracket at its indentation, when longer than ``most`` lines."""
    if text.count("\n") < most:
        return text
    rows, out, i, start = text.split("\n"), [], 0, re.compile(opens)
    while i < len(rows):
        j = i + 1
        if start.match(rows[i]):
            indent = len(rows[i]) - len(rows[i].lstrip())
            while j < len(rows) and rows[j].strip() and not re.match(rf"\s{{{indent}}}[\]}})]", rows[j]):
                j += 1
            j = min(len(rows), j + 1)
        block = rows[i:j]
        out += block if len(block) <= most else block[:head] + [_more(len(block) - head - tail)] + block[-tail:]
        i = j
    return "\n".join(out)


def by_rule(text: str, sample: int = 3, stray: int = 5) -> str:
    """Findings of a checker (path:line:column: CODE text) grouped by code, ``sample`` of each."""
    if not re.search(r":\d", text):
        return text
    groups: dict[str, list[str]] = defaultdict(list)
    other = []
    for r in text.split("\n"):
        m = re.match(r"\S+:\d+(?::\d+)?:?\s+(?:error|warning)?\s*\[?([A-Z]{1,4}\d{2,5}|[a-z]+-[a-z-]+)\]?", r)
        (groups[m.group(1)] if m else other).append(r)
    if not groups:
        return text
    out = [r for r in other if r.strip()][:stray]
    for code in sorted(groups):
        g = groups[code]
        out += [f"{code} ({len(g)}):", *(f"  {r}" for r in g[:sample])] + [f"  +{len(g) - sample} more"] * (len(g) > sample)
    return "\n".join(out)


def sections(text: str, sample: int = 5) -> str:
    """Header lines that end in a colon, each with its first ``sample`` indented lines."""
    if not re.search(r"(?m):[^\S\n]*$", text):
        return text
    out, inside, left = [], 0, 0
    for r in [*text.split("\n"), "end:"]:
        if re.match(r"\S.*:\s*$", r):
            out += [_more(left)] * bool(left)
            inside, left = 1, 0
            out.append(r)
        elif inside and re.match(r"\s+\S", r):
            left += inside > sample
            out += [r] * (inside <= sample)
            inside += 1
        else:
            out.append(r)
    return "\n".join(out[:-1])


def sixty_forty(text: str, budget: int = 3000) -> str:
    """A text over its budget of characters: six tenths from the start, the rest from the end."""
    if len(text) <= budget:
        return text
    head = budget * 6 // 10
    return f"{text[:head]}\n{_more(len(text) - budget, 'characters')}\n{text[len(text) - budget + head :]}"


def narrow(text: str, width: int = 200) -> str:
    return "\n".join(r if len(r) <= width else r[:width] + "..." for r in text.split("\n"))


_PY_PASSING = re.compile(r"(?=\S+?\.py::\S)\S++[ \t]++(?:PASSED|XPASS)(?:[ \t]+\[[ \t]*\d+%\])?[ \t]*")
_SOLID = re.compile(r"\S+[ \t]*")


def _before_ok(row: str) -> str | None:
    """What stands before '... ok' at the end of a line."""
    r = row.rstrip(" \t")
    r = r[:-2].rstrip(" \t") if r.endswith(("ok", "OK")) else ""
    return r[:-3] if r.endswith("...") else None


def _names_test(row: str) -> bool:
    """Whether a line is test_name or test_name (where)."""
    if not row.startswith("test_"):
        return False
    if (m := _SOLID.match(row, 5)) and m.end() == len(row) and not row.endswith((" ", "\t")):
        return True
    at = row.find("(", max(6, row.rfind(")", 0, -1) + 1)) if row.endswith(")") else -1
    return 0 < at < len(row) - 2 and _SOLID.fullmatch(row, 5, at) is not None


def _passing(rows: list[str], i: int) -> int:
    """How many lines the passing test that begins at line ``i`` takes; none if none begins there."""
    row = rows[i]
    if _PY_PASSING.fullmatch(row):
        return 1
    if not row.startswith("test_"):
        return 0
    if i + 1 < len(rows) and not rows[i + 1].startswith("test_") and _before_ok(rows[i + 1]) is not None and _names_test(row):
        return 2
    return int((head := _before_ok(row)) is not None and _names_test(head.rstrip(" \t")))


def test_runs(text: str) -> str:
    """Runs of passing tests (a line each, or two with a description) as one marker; failures and all else stay."""
    if "test_" not in text and ".py::" not in text:
        return text
    rows, out, i, n = text.split("\n"), [], 0, 0
    while i < len(rows):
        k = _passing(rows, i)
        if n and not k:
            out.append(f"... [{n} passing tests]")
        n = n + 1 if k else 0
        out += [] if k else [rows[i]]
        i += k or 1
    return "\n".join(out + [f"... [{n} passing tests]"] * bool(n))


_KEPT = re.compile(
    r"[ \t]*(?:@\S+|(?:async\s+)?def\s+\w|class\s+\w|from\s+\S+\s+import\b|import\s+\w|if\s+__name__\s*==|[A-Z][A-Z0-9_]*\s*(?::[^=]+)?=)"
)


def python_slice(text: str) -> str:
    """Definitions, imports and constants of a piece of Python that need not parse; what lies between is counted."""
    out = []
    for kept, rows in groupby(text.splitlines(), key=lambda r: _KEPT.match(r) is not None):
        out += rows if kept else [f"    # {_more(len(list(rows)))}"]
    return "\n".join(out)


def python_outline(text: str, least: float = 0.8) -> str:
    """A module with its functions' docstrings in place of their bodies. What does not parse, or is nested too deep to be
    written again, is outlined by lines, if that leaves less than ``least`` of it."""
    try:
        tree = ast.parse(text)
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                told = ast.get_docstring(node, clean=False) is not None
                node.body = node.body[:told] + [ast.Expr(ast.Constant(...))]
        return ast.unparse(ast.fix_missing_locations(tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        short = python_slice(text)
        return short if len(short) < least * len(text) else text


SHORTENERS: dict[str, Callable[[str], str]] = {
    f.__name__: f for f in (diff_context, patch_hunks, history, work_tree, steps, error_report, long_blocks, by_rule, sections, sixty_forty, narrow, test_runs, python_outline)
}


def register(name: str, f: Callable[[str], str]) -> None:
    """Add a shortener of one's own under a new name."""
    if name in SHORTENERS:
        raise ValueError(f"{name} is taken")
    SHORTENERS[name] = f


def narrow_column(text: Column, width: int = 200) -> Column:
    cut = F.transform(F.split(text, "\n"), lambda r: F.when(F.length(r) <= width, r).otherwise(F.concat(F.substring(r, 1, width), F.lit("..."))))
    return F.array_join(cut, "\n")


def sixty_forty_column(text: Column, budget: int = 3000) -> Column:
    head, n = budget * 6 // 10, F.length(text)
    marker = F.concat(F.lit("\n... ["), (n - budget).cast("string"), F.lit(" more characters]\n"))
    return F.when(n <= budget, text).otherwise(F.concat(F.substring(text, 1, head), marker, F.right(text, F.lit(budget - head))))


#: rules that stay in the JVM
COLUMNS: dict[str, Callable[[Column], Column]] = {"narrow": narrow_column, "sixty_forty": sixty_forty_column}


def shortened(name: str):
    """A shortener as a column function."""
    if name in COLUMNS:
        return COLUMNS[name]
    f = SHORTENERS[name]

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(f, na_action="ignore")

    return run


def lengths(text: Column) -> Column:
    """How many characters each shortener leaves, as a struct of the functions' names (those of the JVM aside).

    All share one step in Python that gets each text once and returns numbers; as columns of their own each would be a
    step with a worker of its own in every task.
    """
    rules = {n: f for n, f in SHORTENERS.items() if n not in COLUMNS}

    @F.pandas_udf(", ".join(f"{n} int" for n in rules))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({n: p.map(lambda t, f=f: len(f(t)), na_action="ignore").astype("Int32") for n, f in rules.items()})

    return run(text)
