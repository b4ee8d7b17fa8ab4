"""Source files that nobody wrote by hand where they lie: generated, minified, vendored, or data kept as code.

Three kinds of evidence, all computed over every file:

* what a file says of itself: its leading and its closing comment block, and its path;
* an inverted index of rare line hashes: the lines of files that are vendored on
  that evidence, held against the lines of all other files. The containment of a
  file in the vendored lines of *other* repositories is exact (every line of the
  file counts), and finds copies that lost their header or were edited;
* the composition of the tokens that remain without strings and comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_kernels import list_column, mix
from millrace.session import staged

CONTAINMENT = 0.6  # share of a file's own lines that vendored files of other repositories hold
RARE_REPOS = 0.5  # a line that files not called vendored hold in more than this share of all repositories (and in more than two) says nothing
LINE_CHARS = 15

# Folder names that hold third-party code, by wide convention.
VENDOR_FOLDERS = (
    "vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components",
    "site-packages", "dist-packages", "extern", "external", "deps", "godeps", "pods", "jspm_packages",
)
_VENDORED = re.compile(
    r"taken (?:over )?(?:unchanged |unmodified )?from\b|(?:copied|vendored|imported|adapted) (?:unchanged |verbatim )?from\b.*\d"
    r"|^\W*upstream:|^\W*local (?:changes|modifications):|\(c\).* (?:contributors|authors|maintainers)\b"
    r"|^\W*[\w.-]+ v\d+\.\d+(?:\.\d+)?\s*$"
    r"|\b(?:permission is (?:hereby )?(?:given|granted)|released under the|redistribution and use)\b",
    re.I | re.M,
)
_GENERATED = re.compile(
    r"\b(?:auto(?:matically)?[ -]?generated|machine[ -](?:written|generated)|code generated|generated (?:by|from|with|using) |autogenerated)\b|<auto-generated|@generated\b"
    r"|\bdo not (?:edit|modify|change)\b|changes (?:to it |made here |to this file )?will be (?:lost|overwritten)"
    r"|produced by .{0,80}\b(?:rebuild|regenerate)\b|\brun .{0,60} to (?:rebuild|regenerate) this file",
    re.I,
)
_GENERATED_PATH = re.compile(
    r"(?:^|/)(?:zz_generated[^/]*|[^/]*_pb2(?:_grpc)?\.py|[^/]*[._]pb\.[a-z]+|[^/]*\.pb[.-][^/]*|[^/]*\.g\.[a-z]+|[^/]*OuterClass\.java|[^/]*\.(?:generated|designer|gen)\.[a-z]+)$"
    r"|(?:^|/)(?:build|target|out)/(?:gen|generated)[^/]*/|(?:^|/)(?:generated|__generated__|generated-sources|gen-src)/",
    re.I,
)
_MIN_PATH = re.compile(r"[.-]min\.(?:js|css|mjs)$|\.(?:bundle|prod)\.(?:js|mjs)$", re.I)

_STRING_OR_COMMENT = {
    True: re.compile(r'("""|\'\'\').*?(?:\1|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*', re.S),
    False: re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S),
}
_NUMBER = re.compile(r"\b\d[\w.]*")
_WORD = re.compile(r"[^\W\d]\w*")
_BLOCK = re.compile(r"\A(?:﻿?#![^\n]*\n)?\s*((?:(?:#|//)[^\n]*(?:\n\s*|\Z))+|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?:\"\"\").*?(?:\"\"\"|\Z))", re.S)
_FOREIGN = re.compile(r"\A\s*(?:#!(?![^\n]*(?:python|node|deno|rust))|<!DOCTYPE|<\?xml|<html)|(?:^- [^\n]*\n){3}", re.I | re.M)
_SAYS = ("says_vendored", "says_generated", "ends_vendored", "ends_generated")
_FIELDS = ("lines", "code", "long", "white", "words", "numbers", "strings", "blob", "text", "foreign")


def _hash(values: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), dtype=np.uint64, count=len(values))


def closing(text: str, python: bool) -> str:
    """The comment that ends a piece of code."""
    text = text.rstrip()
    for begin, end in (("<!--", "-->"),) if python else (("/*", "*/"), ("<!--", "-->")):
        if text.endswith(end) and begin in text:
            return text[text.rfind(begin) :]
    rows = text.split("\n")
    first = len(rows)
    while first and (not rows[first - 1].strip() or rows[first - 1].lstrip().startswith("#" if python else "//")):
        first -= 1
    return "\n".join(rows[first:])


def describe(text: str, path: str) -> tuple[list[int], list[str], list[str], str, str]:
    """Counts (see ``_FIELDS``), distinct line shapes, distinct telling lines, and the leading and the closing comment of a piece of code."""
    python = path.lower().endswith((".py", ".pyi", ".rb", ".sh"))
    head = _BLOCK.match(text)
    blob = strings = 0

    def replace(m: re.Match) -> str:
        nonlocal blob, strings
        s = m.group()
        if s[0] in "\"'`":
            strings += 1
            if len(s) > 200 and len(s.split(None, 4)) < 4:
                blob += len(s)
            return '"'
        return ""

    code = _STRING_OR_COMMENT[python].sub(replace, text)
    shapes, numbers = _NUMBER.subn("9", code)
    shapes, words = _WORD.subn("w", shapes)
    rows = [r for r in map(str.strip, shapes.split("\n")) if r]
    long = sum(len(r) for r in code.split("\n") if len(r) > 300)
    own = {r for r in map(str.strip, text.split("\n")) if len(r) >= LINE_CHARS and not r.startswith(("#", "//", "/*", "*"))}
    return (
        [len(rows), len(code), long, sum(map(code.count, " \t\n\r")), words, numbers, strings, blob, len(text), int(bool(_FOREIGN.search(text)))],
        list(dict.fromkeys(rows)),
        sorted(own),
        head.group(1) if head else "",
        closing(text, python),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shapes, lines, heads, ends = [], [], [], [], []
        for text, path in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist()):
            c, s, own, h, e = describe(text or "", path)
            counts.append(c)
            shapes.append(s)
            lines.append(own)
            heads.append(h)
            ends.append(e)
        arrays = [batch.column(i) for i in range(4)]
        for values in (shapes, lines):
            flat = mix(_hash([v for x in values for v in x])) if any(values) else np.zeros(0, np.uint64)
            arrays.append(list_column(flat.view(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in values])]), pa.int64()))
        table = np.array(counts, dtype=np.int64).reshape(-1, len(_FIELDS))
        arrays += [pa.array([bool(says.search(c)) for c in part]) for part in (heads, ends) for says in (_VENDORED, _GENERATED)]
        arrays += [pa.array(table[:, i]) for i in range(len(_FIELDS))]
        yield pa.RecordBatch.from_arrays(arrays, names=["repo", "file_path", "chunk_id", "start_line", "shapes", "own", *_SAYS, *_FIELDS])


_SCHEMA = "repo string, file_path string, chunk_id long, start_line int, shapes array<long>, own array<long>, " + ", ".join([f"{f} boolean" for f in _SAYS] + [f"{f} long" for f in _FIELDS])


def _composition() -> Column:
    """What the tokens of a whole file show: ``minified``, ``data``, ``generated`` or null."""
    c = {f: F.col(f) for f in (*_FIELDS, "kinds")}
    code = F.greatest(c["code"], F.lit(1))
    literals, tokens = c["numbers"] + c["strings"], F.greatest(c["numbers"] + c["strings"] + c["words"], F.lit(1))
    return (
        F.when((c["code"] >= 400) & (c["long"] >= 0.5 * code) & (literals < 0.7 * tokens) & (c["white"] < 0.12 * code), "minified")
        .when((literals >= 0.7 * tokens) & (literals >= 60), "data")
        .when((c["blob"] >= 1000) & (c["blob"] >= 0.7 * c["text"]), "data")
        .when((c["lines"] >= 8) & (c["kinds"] <= 0.3 * c["lines"]) & (c["kinds"] <= 9) & (c["foreign"] == 0), "generated")
    )


def not_hand_written(chunks: DataFrame) -> DataFrame:
    """``(repo, file_path, reason, containment)`` of every file; ``reason`` is null for hand-written ones. ``containment``
    is the share of its lines that vendored files of other repositories hold, also for files that are named on other evidence.

    Reasons: vendored, generated, minified, data. Repeated deliveries of a ``chunk_id`` count once. A null repo is
    a repository of its own; rows without a path or a chunk id are left out; null and empty contents are hand-written
    unless path or other chunks say otherwise. ``language`` is not needed. Extra columns are not read.
    """
    pieces = chunks.select(
        "repo", "file_path", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("start_line").cast("int").alias("start_line"), "content"
    ).where("file_path IS NOT NULL AND chunk_id IS NOT NULL")
    found = staged(pieces.mapInArrow(_features, _SCHEMA), "code_features")
    once = found.repartition("repo", "file_path").dropDuplicates(["repo", "file_path", "chunk_id"])
    first = F.struct(F.col("start_line"), F.col("chunk_id"))
    files = once.groupBy("repo", "file_path").agg(
        *[F.sum(f).alias(f) for f in _FIELDS],
        F.size(F.array_distinct(F.flatten(F.collect_list("shapes")))).alias("kinds"),
        F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"),
        *[(F.min_by("says_" + c, first) | F.max_by("ends_" + c, first)).alias("says_" + c) for c in ("vendored", "generated")],
    )
    folder = F.split(F.lower("file_path"), "/")
    in_vendor = F.arrays_overlap(F.slice(folder, 1, F.greatest(F.size(folder) - 1, F.lit(0))), F.array(*map(F.lit, VENDOR_FOLDERS)))
    said = (
        F.when(in_vendor | F.col("says_vendored"), "vendored")
        .when(F.col("says_generated") | F.col("file_path").rlike(f"(?i){_GENERATED_PATH.pattern}"), "generated")
    )
    files = staged(
        files.select("repo", "file_path", "own", said.alias("said"), _composition().alias("tokens"), F.col("file_path").rlike(f"(?i){_MIN_PATH.pattern}").alias("min_name"),
                     (F.col("long") >= 0.5 * F.greatest("code", F.lit(1))).alias("long_lines")),
        "code_files",
    )
    posted = files.select("repo", "said", F.explode("own").alias("line"))
    # one row a line: whether vendored files hold it, and whether those lie in more than one repository
    index = posted.where("said = 'vendored'").groupBy("line").agg(F.min(F.coalesce("repo", F.lit(""))).alias("low"), F.max(F.coalesce("repo", F.lit(""))).alias("high"))
    most = max(2, RARE_REPOS * files.select("repo").distinct().count())
    holders = posted.where("said IS NULL OR said <> 'vendored'").join(index, "line", "left_semi").select("line", "repo").distinct()
    index = index.join(holders.groupBy("line").count().where(F.col("count") > most), "line", "left_anti")
    other = files.where("size(own) > 0").select("repo", "file_path", F.size("own").alias("n"), F.explode("own").alias("line"))
    elsewhere = (F.coalesce("repo", F.lit("")) != F.col("low")) | (F.col("low") != F.col("high"))
    shared = other.join(index, "line").where(elsewhere).groupBy("repo", "file_path", "n").agg(F.count("*").alias("held"))
    held = shared.select(F.col("repo").alias("r"), F.col("file_path").alias("p"), (F.col("held") / F.col("n")).alias("containment"))
    same = F.col("repo").eqNullSafe(F.col("r")) & (F.col("file_path") == F.col("p"))
    reason = (
        F.when(F.col("said").isNotNull(), F.col("said"))
        .when(F.col("containment") >= CONTAINMENT, "vendored")
        .when(F.col("min_name") & F.col("long_lines"), "minified")
        .otherwise(F.col("tokens"))
    )
    return files.join(held, same, "left").select("repo", "file_path", reason.alias("reason"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
