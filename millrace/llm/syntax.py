"""Source files that do not parse in the language of their extension.

A file is parsed by generalised LL (``gll``) with all dialect grammars of its
language at once, and is flagged when none accepts it. Parsing runs bottom-up
over bracket groups: brackets nest in every program, so a group may be parsed by
itself and then stands as one token that bears the names of all rules its inside
derives. Identifiers, numbers and strings are reduced to one token each first.
What is parsed is remembered by its reduced text, and a list of statements whose
lines are each complete needs no parse of the whole; where that does not hold,
the whole inside is parsed. Few insides are new, so most of the work is done by
regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.gll import Grammar
from millrace.llm.grammars import ALIASES, GRAMMARS

EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "go": "go", "java": "java", "rs": "rust", "c": "c",
}

_STRING, _CHAR, _LIFETIME, _FIRST_GROUP, _LAST = "", "", "", 0xE100, 0xF8FF
_BOUND = 100_000  # remembered texts of one kind; beyond it the memory starts anew

_DQ, _SQ = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_PATTERN = r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
_REGEX = rf"(?<=[=(,:;!&|?{{}}\[\n])[ \t]*{_PATTERN}"
# behind the head of a statement, too, a slash begins a pattern
_HEADED = rf"(?P<head>(?<![\w$.])(?:if|while|for|with)[ \t]*\((?:[^()\n'\"`/]|\([^()\n'\"`/]*\))*\)[ \t]*){_PATTERN}"


def _template(depth: int) -> str:
    """A template whose places may hold templates, ``depth`` levels deep."""
    place = rf"(?>[^`{{}}]|{_template(depth - 1)}|\{{(?>[^`{{}}]|{_template(depth - 1)})*+\}})*+" if depth else "[^`{}]*+"
    return rf"`(?>\\.|[^`\\$]|\$(?!\{{)|\$\{{{place}\}})*+`"


_TEMPLATE = rf"{_template(3)}|`(?:\\.|[^`\\])*`"
# places of a formatted string may hold quotes of its own kind
_FORMATTED = "|".join(rf"(?:[rR]?[fF]|[fF][rR]){q}(?!{q}{q})(?>\\.|[^{q}\\{{}}\n]|\{{\{{|\}}\}}|\{{(?>[^{{}}{q}\n]|{q}[^{q}{{}}\\\n]*{q}|\{{[^{{}}{q}\n]*\}})*+\}})*+{q}" for q in "\"'")
_LITERALS = {
    "javascript": rf"{_SLASHES}|{_DQ}|{_SQ}|{_TEMPLATE}|{_HEADED}|{_REGEX}",
    "typescript": rf"{_SLASHES}|{_DQ}|{_SQ}|{_TEMPLATE}|{_HEADED}|{_REGEX}",
    "go": rf"{_SLASHES}|{_DQ}|`[^`]*`|'(?:\\[^\n]+?|[^'\\\n])'",
    "java": rf'{_SLASHES}|"""(?:\\.|.)*?"""|{_DQ}|' + r"'(?:\\[^\n]+?|[^'\\\n])'",
    "rust": rf'{_SLASHES}|b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|' + r"b?'(?:\\[^\n]+?|[^'\\\n])'|'[^\W\d]\w*",
    "c": rf"{_SLASHES}|[LuU]?{_DQ}|[LuU]?'(?:\\[^\n]+?|[^'\\\n])+'|(?m:^)[ \t]*#[ \t]*(?:include|define|undef|ifdef|ifndef|if|elif|else|endif|pragma|error|warning|line)\b(?:\\\r?\n|/\*.*?\*/|[^\n])*",
    "python": _FORMATTED + r'|[bBuUrRfF]{0,2}(?:"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''" + rf"|{_DQ}|{_SQ})|#[^\n]*",
}
_CONTEXTUAL = {
    "javascript": {"async", "get", "set", "static", "as", "from", "type", "of", "is", "asserts", "keyof", "readonly", "unique", "infer", "declare", "namespace", "module", "global", "abstract", "interface", "implements", "public", "private", "protected", "override", "accessor", "satisfies", "out", "never", "let", "yield", "await", "enum"},
    "java": {"record", "sealed", "permits", "non", "when", "yield"},
    "rust": {"union", "crate", "auto"},
    "python": {"match", "case", "type"},
}
_CONTEXTUAL["typescript"] = _CONTEXTUAL["javascript"] - {"never", "enum"}
#: words that stand for a class of words
_CLASSES = {
    "java": {w: "prim" for w in ("int", "long", "short", "byte", "char", "boolean", "float", "double")},
    "c": {w: "type" for w in ("int", "long", "short", "char", "float", "double", "void", "signed", "unsigned", "_Bool", "size_t")}
    | {w: "qual" for w in ("const", "static", "extern", "inline", "volatile", "register", "restrict", "typedef", "auto", "_Noreturn")},
}
#: brackets' rules that any sequence of complete lines derives, and what a line before the last must derive
_LISTS = {
    "javascript": ("Block", "Classbody", "Module", "Script"),
    "typescript": ("Block", "Classbody", "Module", "Script", "Objtype"),
    "go": ("Block", "Fields", "Ibody", "Tops"),
    "java": ("Block", "Classbody"),
    "rust": ("Block", "Items", "File"),
    "c": ("Block", "Fields", "File"),
    "python": ("Suite", "Suite310", "Suite312", "Cases", "Python38", "Python310", "Python312"),
}
_BEFORE_LAST = {"rust": {"Block": "Stmts"}}

_INNER = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_INNER_SUITE = re.compile("\x02[^\x02\x03]*\x03")
_SPACE = re.compile(r"[ \t\f\r]+")
_EDGES = re.compile(r" ?\n[ \n]*")
_NUMBER = re.compile(r"(?<![\w$])\d(?:\w|\.(?!\.))*")
_LITERAL_LIST = re.compile(rf"([9{_STRING}])(?:\s*,\s*\1){{3,}}")
_GROUP_LIST = re.compile(rf"([{chr(_FIRST_GROUP)}-{chr(_LAST)}])(?:\s*,\s*\1){{2,}}")
_CONTINUES = re.compile(r"\n(?=(?:else|elif|except|catch|finally)\b)")
_NAMELESS = re.compile(rf"(?:^|;)\s*(?:async )?function ?\*? ?[{chr(_FIRST_GROUP)}-{chr(_LAST)}]")  # no statement begins with a function that has no name
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_TOKENS = re.compile(
    rf"(?P<word>[^\W\d]\w*)|(?P<number>9)|(?P<group>[{_STRING}-{chr(_LAST)}])|(?P<line>\n)|(?P<space>[ \t]+)"
    r"|(?P<asg>(?:>>>|<<|>>|\*\*|//|&&|\|\||\?\?|&\^|[-+*/%&|^@])=(?!=))|(?P<inc>\+\+|--)"
    r"|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||\?\?|&\^|<<|\*\*|//(?!=)|%|\^)"
    r"|(?P<sign>\.\.\.|\.\.=|\.\.|\?\.(?!\d)|=>|->|<-|:=|::|.)",
    re.S,
)
_ALSO = {"||": "||", "**": "**", "^": "xor", "&&": "&&"}


class Language:
    """A grammar with what has been parsed by it so far."""

    def __init__(self, name: str):
        text, round_, square, curly, self.starts = GRAMMARS[name]
        self.name, self.grammar = name, Grammar(text)
        self.rules = {"(": round_, "[": square, "{": curly, "\x02": ("Suite", "Suite310", "Suite312", "Cases")}
        self.words = set(re.findall(r'"([A-Za-z_]\w*)"', text)) | set(_CLASSES.get(name, ()))
        self.signs = set(re.findall(r'"([^"\w]{2,})"', text))
        self.soft = _CONTEXTUAL.get(name, set())
        self.literals = re.compile(_LITERALS[name], re.S)
        hard = "|".join(sorted(self.words, key=lambda w: (-len(w), w)))
        self.names = re.compile(rf"(?<![\w$])(?!(?:{hard})(?![\w$]))(?:[^\W\d]|\$)[\w$]*")
        self.groups: dict[str, str] = {}
        self.lines: dict[str, frozenset[str]] = {}
        self.files: dict[str, bool] = {}
        self.labels: dict[frozenset[str], str] = {}
        self.meaning: dict[str, frozenset[str]] = {
            _STRING: frozenset(("s",)),
            _CHAR: frozenset(("c",)),
            _LIFETIME: frozenset(("life",)),
        }
        self.lists = _LISTS.get(name, ())
        self.before = _BEFORE_LAST.get(name, {})

    # -- reduction to tokens --

    def _literal(self, m: re.Match) -> str:
        s = m.group()
        c = s.lstrip(" \t")[:1]
        if self.name == "python":
            return "" if c == "#" else _STRING
        if s[:2] in ("//", "/*"):
            return "\n" if "\n" in s else " "
        if c == "#":
            return ""
        if c == "/":
            return _STRING
        if "head" in self.literals.groupindex and m["head"]:
            return m["head"] + _STRING
        if s.endswith("'") and self.name in ("go", "java", "rust", "c"):
            return _CHAR if self.name != "go" else "9"
        return _LIFETIME if s[0] == "'" and self.name == "rust" else _STRING

    def plain(self, text: str) -> str:
        t = self.literals.sub(self._literal, text.replace("\r\n", "\n"))
        t = self.names.sub("x", _NUMBER.sub("9", t))
        return _LITERAL_LIST.sub(r"\1,\1", t)

    def tokens(self, text: str) -> list[frozenset[str]]:
        out, line = [], False
        for m in _TOKENS.finditer(text):
            kind, s = m.lastgroup, m.group()
            if kind == "space":
                continue
            if kind == "line":
                line = True
                continue
            if kind == "word":
                names = {_CLASSES.get(self.name, {}).get(s, s)} | ({"x"} if s in self.soft else set())
            elif kind == "number":
                names = {"n"}
            elif kind == "group":
                names = set(self.meaning.get(s, ()))
            elif kind in ("asg", "inc"):
                names = {kind}
            elif kind == "op":
                names = {"op", _ALSO.get(s, "op")}
            elif len(s) > 1 and s not in self.signs:  # a sign of other languages
                out += [frozenset({c, "^"}) if line and not k else frozenset((c,)) for k, c in enumerate(s)]
                line = False
                continue
            else:
                names = {s}
            out.append(frozenset(names | {"^"}) if line else frozenset(names))
            line = False
        return out

    # -- bracket groups --

    def _label(self, rules: frozenset[str]) -> str:
        if (c := self.labels.get(rules)) is None:
            c = self.labels[rules] = chr(_FIRST_GROUP + len(self.labels))
            names = {ALIASES.get(r.lower(), r.lower()) for r in rules}
            self.meaning[c] = frozenset(names | {"any"})
        return c

    def _parse(self, rules: tuple[str, ...], text: str) -> frozenset[str]:
        return self.grammar.accepts(list(rules), self.tokens(text))

    def _line(self, line: str) -> frozenset[str]:
        if (found := self.lines.get(line)) is None:
            if len(self.lines) > _BOUND:
                self.lines.clear()
            found = self.lines[line] = self._parse((*self.lists, *self.before.values()), line)
        return found

    def body(self, rules: tuple[str, ...], text: str) -> frozenset[str]:
        """Which of ``rules`` derive a text of several lines, line by line where that is enough."""
        if _NAMELESS.search(text) and self.name in ("javascript", "typescript"):
            rules = tuple(r for r in rules if r not in ("Block", "Module", "Script"))
        rows = [r for r in (r.strip() for r in _CONTINUES.sub(" ", text).split("\n")) if r]
        if len(rows) > 1:
            good = None
            for row in set(rows[:-1]):
                own = self._line(row)
                good = own if good is None else good & own
                if not good:
                    break
            if good:
                last = self._line(rows[-1])
                found = frozenset(r for r in rules if r in self.lists and r in last and self.before.get(r, r) in good)
                if found:
                    return found
        return self._parse(rules, "\n".join(rows))

    def _group(self, m: re.Match) -> str:
        s = m.group()
        if (c := self.groups.get(s)) is None:
            if len(self.groups) > _BOUND:
                self.groups.clear()
            if s[0] == "\x02":
                found = self.body(self.rules["\x02"], s[1:-1])
            elif _PAIRS[s[0]] != s[-1]:
                found = frozenset(("Mismatched",))
            else:
                inside = _GROUP_LIST.sub(r"\1,\1", s[1:-1]).strip()
                found = self.body(self.rules[s[0]], inside) if s[0] == "{" and self.name != "python" else self._parse(self.rules[s[0]], inside)
            c = self.groups[s] = self._label(found)
            if "Mismatched" in found:
                self.meaning[c] = frozenset(("mismatched",))
        return c

    def reduce(self, text: str, inner: re.Pattern = _INNER) -> str:
        n = 1
        while n:
            text, n = inner.subn(self._group, text)
        return text

    # -- files --

    def valid(self, text: str) -> bool:
        t = self.plain(text[1:] if text[:1] == "﻿" else text)
        if self.name == "python":
            t = self.reduce(t.replace("\\\n", " "))
            t = _indented(t)
            if t is None:
                return False
            t = self.reduce(t, _INNER_SUITE)
        else:
            if t.startswith("#!") and self.name in ("javascript", "typescript", "rust"):
                t = t[t.find("\n") :] if "\n" in t else ""
            t = self.reduce(_EDGES.sub("\n", _SPACE.sub(" ", t)))
        t = _GROUP_LIST.sub(r"\1,\1", t.strip())
        if (ok := self.files.get(t)) is None:
            if len(self.files) > _BOUND:
                self.files.clear()
            ok = self.files[t] = self._file(t)
        return ok

    def _file(self, t: str) -> bool:
        if re.search("[\\[\\](){}\x02\x03]", t):
            return False
        if not t:
            return self.name != "go"
        if self.name == "go":
            head, _, rest = t.partition("\n")
            if self._parse(("Pack",), head) and rest and self.body(("Tops",), rest):
                return True
        return bool(self.body(self.starts, t))


def _indented(text: str) -> str | None:
    """Python's indentation as brackets \\x02 and \\x03 around each suite; None where a dedent fits no level."""
    out, levels, opens = [], [(0, 0)], False
    for line in text.split("\n"):
        body = line.strip(" \t\f\r")
        if not body:
            continue
        lead = line[: len(line) - len(line.lstrip(" \t\f"))].rpartition("\f")[2]
        # with tabs of eight columns, and of one: both must tell the same
        depth = (len(lead.expandtabs(8)), len(lead))
        if depth[0] > levels[-1][0]:
            if not opens or depth[1] <= levels[-1][1]:
                return None
            levels.append(depth)
            out.append("\x02")
        else:
            if opens:
                return None
            while depth[0] < levels[-1][0]:
                levels.pop()
                out.append("\x03")
            if depth != levels[-1]:
                return None
        out.append("\n")
        out.append(_SPACE.sub(" ", body))
        opens = body[-1] == ":"
    if opens:
        return None
    out.append("\x03" * (len(levels) - 1))
    return _CONTINUES.sub(" ", re.sub(" ?\n\x02|\x02\n", "\x02", "".join(out)).replace("\x03\n", "\x03\n"))


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    return Language(name)


def parses(text: str, extension: str) -> bool | None:
    """Whether a text is valid in the language of ``extension``; None for an extension that is not supported."""
    name = EXTENSIONS.get(extension.lower())
    return None if name is None else language(name).valid(text)


def _flag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ok = [parses("\n".join(p[2] or "" for p in pieces), e) for pieces, e in zip(frame["pieces"].map(lambda ps: [(p["s"], p["c"], p["t"]) for p in ps]), frame["extension"])]
        out = frame[["repo", "file_path", "extension"]].copy()
        out["broken"] = pd.array([None if x is None else not x for x in ok], dtype="boolean")
        yield out


def parsed_files(chunks: DataFrame) -> DataFrame:
    """``(repo, file_path, extension, broken)`` of every file.

    The whole text of a file is its chunks by ``start_line``, joined by line breaks; repeated deliveries of a
    ``chunk_id`` count once. ``broken`` is null for extensions without a grammar. An empty file is valid but in Go.
    A null repo is a repository of its own, a null content counts as empty; rows without path or chunk id are left out.
    Other columns are not read.
    """
    piece = F.struct(F.col("start_line").cast("int").alias("s"), F.col("chunk_id").cast("long").alias("c"), F.col("content").alias("t"))
    files = (
        chunks.where("file_path IS NOT NULL AND chunk_id IS NOT NULL")
        .select("repo", "file_path", piece.alias("piece"))
        .repartition("repo", "file_path")
        .groupBy("repo", "file_path")
        .agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
        .select("repo", "file_path", F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), "pieces")
    )
    return files.mapInPandas(_flag, "repo string, file_path string, extension string, broken boolean")


def broken_rates(chunks: DataFrame) -> DataFrame:
    """``(repo, language, files, broken_files, broken_rate)``; files without a grammar are left out."""
    names = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    n = F.count_if("broken")
    return (
        parsed_files(chunks)
        .where("broken IS NOT NULL")
        .groupBy("repo", names[F.col("extension")].alias("language"))
        .agg(F.count("*").alias("files"), n.alias("broken_files"), (n / F.count("*")).alias("broken_rate"))
    )
