"""Source files to chunks: by definition where Python parses, else by line windows. Also outlines of JSON texts."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP, MOST = 2500, 300, 4000


def files(chunks: DataFrame) -> DataFrame:
    """``(repo, file_path, source)``: chunks by line, joined by line breaks; repeated deliveries count once."""
    piece = F.struct("start_line", "chunk_id", "content")
    return (
        chunks.where("file_path IS NOT NULL AND chunk_id IS NOT NULL")
        .groupBy("repo", "file_path")
        .agg(F.array_sort(F.collect_set(piece)).alias("p"))
        .select("repo", "file_path", F.array_join(F.transform("p", lambda x: F.coalesce(x["content"], F.lit(""))), "\n").alias("source"))
    )


def windows(lines: list[str], first: int = 1, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Line ranges of about ``target`` characters; each begins with the last lines, up to ``overlap`` characters, of the one before."""
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) + 1 <= target):
            size += len(lines[end]) + 1
            end += 1
        yield first + at, first + end - 1
        if end >= len(lines):
            return
        back, size = end, 0
        while back - 1 > at and size + len(lines[back - 1]) + 1 <= overlap:
            back -= 1
            size += len(lines[back]) + 1
        at = back


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([*([node.id] if isinstance(node, ast.Name) else []), *reversed(parts)])


def cut(source: str, path: str) -> list[tuple]:
    """``(symbol, kind, first line, last line, signature, calls, imports, extends)`` of each chunk."""
    lines = source.split("\n")
    found = []
    if path.lower().endswith(".py"):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            tree = None
        nodes = tree.body if tree else []
        imports = sorted({f"{n.module or ''}.{a.name}".lstrip(".") if isinstance(n, ast.ImportFrom) else a.name for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}) if tree else []
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "type" if isinstance(n, ast.ClassDef) else "async_function" if isinstance(n, ast.AsyncFunctionDef) else "function"
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                signature = n.name if kind == "type" else f"{n.name}({', '.join(a.arg for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs))})"
                calls = sorted({_dotted(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)} - {""})
                bases = [_dotted(b) for b in n.bases] if kind == "type" else []
                body = lines[first - 1 : n.end_lineno]
                parts = [(first, n.end_lineno)] if sum(map(len, body)) + len(body) <= MOST else list(windows(body, first))
                found += [(n.name, kind, a, b, signature, calls, imports, bases) for a, b in parts]
    if not found and source.strip():
        found = [(None, "code", a, b, None, [], [], []) for a, b in windows(lines)]
    return found


def chunks(sources: DataFrame) -> DataFrame:
    """One row a chunk. Null and blank sources give none; a line longer than a window is a chunk of its own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for repo, path, source in zip(f["repo"], f["file_path"], f["source"]):
                lines = (source or "").split("\n")
                for symbol, kind, a, b, signature, calls, imports, bases in cut(source or "", path):
                    text = "\n".join(lines[a - 1 : b])
                    rows.append((repo, path, symbol, kind, a, b, signature, text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), calls, imports, bases))
            yield pd.DataFrame(rows, columns=["repo", "file_path", "symbol", "symbol_kind", "start_line", "end_line", "signature", "content", "chunk_hash", "calls", "imports", "extends"])

    schema = "repo string, file_path string, symbol string, symbol_kind string, start_line int, end_line int, signature string, content string, chunk_hash string, calls array<string>, imports array<string>, extends array<string>"
    return sources.select("repo", "file_path", "source").mapInPandas(run, schema)


def outline(value: object, depth: int = 4, items: int = 2, path: str = "$") -> list[str]:
    """Paths, types and examples of a JSON value, ``depth`` levels down, ``items`` entries of each array."""
    if isinstance(value, dict):
        if not depth:
            return [f"{path}: object of {len(value)}"]
        return [line for k, v in value.items() for line in outline(v, depth - 1, items, f"{path}.{k}")] or [f"{path}: empty object"]
    if isinstance(value, list):
        head = [f"{path}: array of {len(value)}"]
        return head if not depth else head + [line for i, v in enumerate(value[:items]) for line in outline(v, depth - 1, items, f"{path}[{i}]")]
    name = {bool: "boolean", int: "number", float: "number", str: "string", type(None): "null"}[type(value)]
    return [f"{path}: {name} = {json.dumps(value, ensure_ascii=False)[:60]}"]


def json_summary(depth: int = 4, items: int = 2):
    """A column function: the outline of a JSON text; a text that is not JSON stays as it is."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                return text if text is None else "\n".join(outline(json.loads(text), depth, items))
            except (ValueError, RecursionError):
                return text

        for p in parts:
            yield p.map(one, na_action="ignore")

    return run
