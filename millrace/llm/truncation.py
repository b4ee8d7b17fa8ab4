"""Texts that stop before their end.

A trie of the corpus's own words tells whether a text's final token is an
unknown proper prefix of known words. The trie is kept as a table with one row
a node (a prefix, whether it is a word, whether words go on from it), so it
grows with the vocabulary and lives on the executors. The same idea is applied
to line shapes: a last line without a sentence end is whole when the corpus has
its shape inside other texts, or as an ending that no longer ending continues.
Lengths are the second kind of evidence: a source whose longest texts pile up
at one length has a field limit there.

The texts are read once. Each Arrow batch gives one row a text, and its words
and line shapes already counted, so that counts and not texts are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

SUPPORT = 3  # places that make a word known, and the least for a line form or an ending
FORM_SHARE, ENDING_SHARE = 0.005, 0.0005  # of all texts, that must hold a line form or an ending
CONTINUED = 0.2  # an ending may be continued by others in at most this share of its own number
PHRASE = 12  # an ending (tag line, sign-off, list entry, log result) has at most this many words

_END = re.compile(r"[.!?。！？][\"'”’»」』)\]`*_]*$")
_DOTS = re.compile(r"(?:\.\.\.|…)$")
_MARK = re.compile(r"(?:�|[\[(<](?:truncated|cut off|cut|snip(?:ped)?|\.\.\.|…)[^\])>]{0,40}[\])>])$", re.I)
_LOG_LINE = re.compile(r"^\s*(?:\d\d:\d\d:\d\d\s|\[\d+\]\s|(?:PASSED|FAILED|ok|skipped)\s|[\w./-]+:\d+:)")
_SENTENCE = re.compile(r"(?:^|[.!?。！？`]\s+)([^.!?。！？`]*(?:\.\.\.|…))$")
_ZERO = re.compile(r"(?:^|\s)0\.$")
_PLAIN = re.compile(r"[wB9 ,]*\Z")  # a run of words, as prose wrapped over lines has, is no form
_FENCE = re.compile(r"(?m)^\s*```")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_LAST_WORD = re.compile(r"[^\W\d_]+\Z")
_CODE, _NUMBER, _LETTERS = re.compile("`[^`]*`"), re.compile(r"\d+(?:[.:]\d+)*"), re.compile(r"[^\W\d]+")


def shape(line: str) -> str:
    """A line with quoted code as B, numbers as 9 and words as w."""
    return _LETTERS.sub("w", _NUMBER.sub("9", _CODE.sub("\x01", line))).replace("\x01", "B")


def _hash(s: str) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(s)
    return h - (1 << 64) if h >= 1 << 63 else h


def ending(text: str) -> tuple[str, int, list[int], list[int], str]:
    """Verdict by the end alone (``cut``, ``whole`` or empty), the shape of the last line, the ending under its three
    descriptions, all shorter beginnings of it, and the sentence that dots close."""
    last = text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]
    tail = text[-200:]
    verdict, dots = "", ""
    if _MARK.search(tail) or len(_FENCE.findall(text)) % 2:
        verdict = "cut"
    elif _DOTS.search(tail):
        m = _SENTENCE.search(last)
        dots = _NUMBER.sub("9", m.group(1) if m else last)
    elif _ZERO.search(tail) or (last.endswith(".") and _LOG_LINE.match(last)):
        verdict = "cut"
    elif _END.search(tail):
        verdict = "whole"
    words = last.split(" ")
    shapes, literals = [shape(w) for w in words], [_NUMBER.sub("9", w) for w in words]
    full, parts = [], []
    for k in range(1, min(len(words), PHRASE) + 1):
        s, prefix = " ".join(shapes[:k]), " ".join(shapes[: k - 1])
        keys = [_hash(f"s {s}"), _hash("l " + " ".join(literals[:k])), _hash(f"m {prefix} {literals[k - 1]}")]
        if k == len(words):
            full = keys
        else:
            parts += keys
    return verdict, _hash(shape(last)), full, parts, dots


_COLUMNS = "source string, h1 long, h2 long, size int, verdict string, shape long, ending array<long>, beginnings array<long>, dots string, token string, word string, line long, n long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        words: Counter[str] = Counter()
        lines: Counter[str] = Counter()
        rows = []
        for text in batch.column(2).to_pylist():
            if text is None:
                rows.append((None, None, None, "whole", None, [], [], "", ""))
                continue
            h1, h2 = xxhash.xxh3_64_intdigest(text), xxhash.xxh64_intdigest(text, 1)
            t = text.rstrip()
            if not t:
                rows.append((h1, h2, len(text), "whole", None, [], [], "", ""))
                continue
            token = _LAST_WORD.search(t[-400:])
            token = (token.group() if token else "") if len(t) <= 400 or not token or len(token.group()) < 400 else _LAST_WORD.search(t).group()
            words.update(_WORD.findall(t[: len(t) - len(token)]))
            inner = (r for r in _FENCED.sub("```", t).split("\n")[:-1])
            shapes = {shape(r) for r in (x.rstrip("\r") for x in inner) if r and not _END.search(r[-12:])}
            lines.update(x for x in shapes if not _PLAIN.match(x))
            rows.append((h1, h2, len(text), *ending(t), token))
        n, w, s = len(rows), list(words), list(lines)
        extra = len(w) + len(s)
        columns = list(zip(*rows)) if rows else [[]] * 9
        signed = lambda xs: pa.array(np.array([x or 0 for x in xs], dtype=np.uint64).view(np.int64), mask=np.array([x is None for x in xs], dtype=bool))
        tail = lambda a: pa.concat_arrays([a, pa.nulls(extra, a.type)])
        ids = batch.column(0)
        yield pa.RecordBatch.from_arrays(
            [
                tail(ids),
                tail(batch.column(1)),
                tail(signed(columns[0])),
                tail(signed(columns[1])),
                tail(pa.array(columns[2], type=pa.int32())),
                tail(pa.array(columns[3], type=pa.string())),
                tail(pa.array(columns[4], type=pa.int64())),
                tail(pa.array(columns[5], type=pa.list_(pa.int64()))),
                tail(pa.array(columns[6], type=pa.list_(pa.int64()))),
                tail(pa.array(columns[7], type=pa.string())),
                tail(pa.array(columns[8], type=pa.string())),
                pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(w, type=pa.string()), pa.nulls(len(s), pa.string())]),
                pa.concat_arrays([pa.nulls(n + len(w), pa.int64()), pa.array([_hash(x) for x in s], type=pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([words[x] for x in w] + [lines[x] for x in s], type=pa.int64())]),
            ],
            names=["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))],
        )


def word_trie(counts: DataFrame) -> DataFrame:
    """``(prefix, is_word, goes_on)`` over the words of ``counts(word, n)`` that enough places hold."""
    words = counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    nodes = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")).select(
        F.expr("substring(word, 1, k)").alias("prefix"), (F.col("k") == F.length("word")).alias("is_word")
    )
    return nodes.groupBy("prefix").agg(F.max("is_word").alias("is_word"), F.max(~F.col("is_word")).alias("goes_on"))


def truncated(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, cut)`` for every row of ``docs(doc_id, source, text)``.

    Copies of one text share one verdict. A null, empty or blank text is not cut, a null source is a source of its
    own, and repeated rows stay repeated. Texts are read whole; other columns are not read.
    """
    wanted = docs.select("doc_id", "source", "text")
    kind = wanted.schema["doc_id"].dataType.simpleString()
    read = staged(wanted.mapInArrow(_read, f"doc_id {kind}, {_COLUMNS}"), "endings")
    rows = read.where("n IS NULL")
    trie = word_trie(read.where("word IS NOT NULL").select("word", "n"))
    lengths = rows.where("size > 0").groupBy("source", "size").agg(F.count_distinct("h1", "h2").alias("texts"))
    limits = lengths.groupBy("source").agg(F.max(F.struct("size", "texts")).alias("m"), F.sum("texts").alias("all")).where(
        (F.col("m.texts") >= SUPPORT) & (F.col("m.texts") >= 0.005 * F.col("all"))
    )
    limits = limits.select(F.coalesce("source", F.lit("\0")).alias("ls"), F.col("m.size").alias("limit"))
    at = F.coalesce(F.col("size") == F.col("limit"), F.lit(False))
    texts = (
        rows.where("h1 IS NOT NULL")
        .join(limits, F.coalesce("source", F.lit("\0")) == F.col("ls"), "left")
        .groupBy("h1", "h2")
        .agg(F.max(at).alias("at_limit"), *[F.first(c).alias(c) for c in ("verdict", "shape", "ending", "beginnings", "dots", "token")])
    )
    texts = staged(texts, "texts")
    total = texts.count()
    form, close = max(SUPPORT, FORM_SHARE * total), max(SUPPORT, ENDING_SHARE * total)
    inner = read.where("line IS NOT NULL").groupBy("line").agg(F.sum("n").alias("places")).where(F.col("places") >= form).select(F.col("line").alias("shape"), F.lit(True).alias("inner_known"))
    both = texts.select(F.explode("ending").alias("key"), F.lit(1).alias("own"), F.lit(0).alias("longer")).union(
        texts.select(F.explode("beginnings").alias("key"), F.lit(0).alias("own"), F.lit(1).alias("longer"))
    )
    endings = both.groupBy("key").agg(F.sum("own").alias("own"), F.sum("longer").alias("longer")).where((F.col("own") >= close) & (F.col("longer") <= CONTINUED * F.col("own")))
    known = (
        texts.select("h1", "h2", F.posexplode("ending").alias("at", "key"))
        .join(endings.select("key"), "key", "left_semi")
        .groupBy("h1", "h2")
        .agg(F.lit(True).alias("ending_known"), F.max(F.col("at") == 1).alias("literal_known"))
    )
    dots = texts.where("dots <> ''").groupBy("dots").agg(F.count("*").alias("k")).where(F.col("k") >= close).select("dots", F.lit(True).alias("dots_known"))
    # most texts end with no word or dots that must be looked up: they take no part in these joins
    words = texts.where("token <> ''").select("h1", "h2", F.col("token").alias("prefix")).join(trie, "prefix").select("h1", "h2", "is_word", "goes_on")
    closed = texts.where("dots <> ''").select("h1", "h2", "dots").join(dots, "dots").select("h1", "h2", "dots_known")
    told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (known, words, closed)).groupBy("h1", "h2")
    told = told.agg(*[F.max(c).alias(c) for c in ("ending_known", "literal_known", "is_word", "goes_on", "dots_known")])
    judged = texts.join(inner, "shape", "left").join(told, ["h1", "h2"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    unknown_prefix = (F.col("token") != "") & ~yes("is_word") & yes("goes_on")
    cut = (
        F.when(F.col("verdict") == "cut", True)
        .when(F.col("verdict") == "whole", False)
        .when(F.col("dots") != "", ~yes("dots_known"))
        .when(unknown_prefix, True)
        .when(yes("inner_known") & F.col("at_limit") & ~yes("literal_known"), True)
        .when(yes("ending_known"), False)
        .otherwise(~yes("inner_known"))
    )
    return (
        rows.select("doc_id", "source", "h1", "h2")
        .join(judged.select("h1", "h2", cut.alias("cut")), ["h1", "h2"], "left")
        .select("doc_id", "source", F.coalesce("cut", F.lit(False)).alias("cut"))
    )


def rates(docs: DataFrame) -> DataFrame:
    """``(source, texts, cut_texts, cut_rate)``."""
    n = F.count_if(F.col("cut"))
    return truncated(docs).groupBy("source").agg(F.count("*").alias("texts"), n.alias("cut_texts"), (n / F.count("*")).alias("cut_rate"))
