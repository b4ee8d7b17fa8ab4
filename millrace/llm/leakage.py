"""Held-out passages inside a training corpus, by q-gram filtering and banded alignment.

Documents and items are read as lower-case ASCII words joined by one space. The
character q-grams an item shares with a document lie on diagonals (position in
the document minus position in the item). A passage of at least ``passage``
words with at most ``edits`` edits leaves, by the q-gram lemma, at least
``length - q + 1 - q * edits`` shared q-grams within ``edits`` diagonals, so
within one of the overlapping bands of twice that width, and so many within
every stretch of ``length`` characters of it. Stretches that reach the bound,
with ``length`` that of the item's shortest passage, are aligned within their
band. A region counts when the alignment matches as many characters as the
shortest passage has, less the edits; the longest run of equal words follows
from the aligned region.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_kernels import code_points, span_hashes, text_slices, word_spans

Q, EDITS, PASSAGE = 12, 1, 12
BLOCK_CHARS = 4_000_000  # characters of items in one broadcast index, about 200 MB at most in a worker
_FILTER_BITS = 23
_HITS = 8_000_000  # postings that are looked at together

_FOLD = np.zeros(128, dtype=np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = ord(_c)


def normal_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case words with single spaces: the bytes, and n+1 offsets."""
    codes, starts = code_points(texts)
    small = np.where(codes < 128, codes, 0).astype(np.uint8)
    folded = _FOLD[small]
    begin, _ = word_spans(codes, folded > 0)
    doc = np.searchsorted(starts, begin, side="right") - 1
    first = np.ones(len(begin), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    folded[begin[~first] - 1] = 32  # the character before a word only separates
    keep = folded > 0
    out = folded[keep]
    ends = np.cumsum(keep)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    offsets[1:-1] = ends[starts[1:] - 1]
    offsets[-1] = len(out)
    return out, offsets


def _grams(norm: np.ndarray, offsets: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all q-grams that stay inside one text."""
    n = len(norm) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(n, dtype=bool)
    for e in offsets[1:-1]:
        inside[max(0, e - q + 1) : e] = False
    at = np.flatnonzero(inside)
    return span_hashes(norm, at, at + q), at


class ItemIndex:
    """Inverted q-gram lists of a bounded block of items."""

    def __init__(self, ids: list, texts: list[str], q: int, edits: int, passage: int):
        self.ids, self.q, self.edits, self.passage = ids, q, edits, passage
        norm, off = normal_text(texts)
        self.norm, self.starts, self.ends = np.append(norm, np.uint8(0)), off[:-1], off[1:]
        self.texts = [norm[off[i] : off[i + 1]].tobytes().decode("ascii") for i in range(len(ids))]
        self.words = [t.split() for t in self.texts]
        ends = [np.cumsum([len(x) + 1 for x in w], dtype=np.int64) - 1 for w in self.words]
        self.spans = [(np.concatenate([[0], e[:-1] + 1]) if len(e) else e, e) for e in ends]
        # the shortest passage of each item, in characters
        self.bound = np.zeros(len(ids), dtype=np.int64)
        self.shortest = np.zeros(len(ids), dtype=np.int64)
        for i, w in enumerate(self.words):
            size = np.array([len(x) + 1 for x in w])
            if len(w) < passage:
                self.bound[i] = np.iinfo(np.int64).max
            else:
                sums = np.convolve(size, np.ones(passage, dtype=np.int64), "valid") - 1
                self.shortest[i] = sums.min()
                self.bound[i] = max(1, int(sums.min()) - q + 1 - q * edits)
        h, at = _grams(norm, off, q)
        item = np.searchsorted(off, at, side="right") - 1
        order = np.argsort(h, kind="stable")
        h, self.item, self.pos = h[order], item[order], (at - off[item])[order]
        self.keys, self.first = np.unique(h, return_index=True)
        self.first = np.append(self.first, len(h))
        self.seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.seen[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        self.runs = [{tuple(w[k : k + passage]) for k in range(len(w) - passage + 1)} for w in self.words]

    def regions(self, norm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(doc, item, lowest and highest diagonal, first and last position in the document) of stretches that meet the bound."""
        none = np.zeros((0, 6), dtype=np.int64)
        h, at = _grams(norm, offsets, self.q)
        near = np.flatnonzero(self.seen[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        h, at = h[near], at[near]
        if not len(h) or not len(self.keys):
            return none
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[k] == h
        k, at = k[hit], at[hit]
        # documents are taken together while the items' lists they hit are short enough in all
        size = np.bincount(np.searchsorted(offsets, at, side="right") - 1, weights=self.first[k + 1] - self.first[k], minlength=len(offsets) - 1)
        turn = (np.cumsum(size) // _HITS)[np.searchsorted(offsets, at, side="right") - 1]
        found = [self._banded(offsets, k[turn == t], at[turn == t]) for t in np.unique(turn)]
        return np.concatenate(found) if found else none

    def _banded(self, offsets: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
        many = self.first[k + 1] - self.first[k]
        rows = np.repeat(np.arange(len(k)), many)
        entry = self.first[k][rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many))
        doc = np.searchsorted(offsets, at, side="right") - 1
        doc, item = doc[rows], self.item[entry]
        # a document with too few hits of an item in all has too few in every band
        pair = doc * len(self.ids) + item
        _, code, total = np.unique(pair, return_inverse=True, return_counts=True) if len(offsets) * len(self.ids) > 1 << 26 else (None, pair, np.bincount(pair))
        enough = total[code] >= self.bound[item]
        doc, item, rows, entry = doc[enough], item[enough], rows[enough], entry[enough]
        where = at[rows] - offsets[doc]
        diagonal = where - self.pos[entry]
        step = self.edits + 1
        band = np.floor_divide(diagonal, step)
        doc, item, where, diagonal = (np.concatenate([x, x]) for x in (doc, item, where, diagonal))
        band = np.concatenate([band, band - 1])  # bands overlap by half: each covers two steps
        order = np.lexsort((where, band, item, doc))
        doc, item, where, diagonal, band = (x[order] for x in (doc, item, where, diagonal, band))
        if not len(doc):
            return np.zeros((0, 6), dtype=np.int64)
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        group = np.cumsum(new) - 1
        # a hit is dense when it and the bound-1 hits behind it lie in one stretch of the shortest passage
        ahead = np.arange(len(doc)) + self.bound[item] - 1
        there = ahead < len(doc)
        ahead = np.where(there, ahead, 0)
        dense = np.flatnonzero(there & (group[ahead] == group) & (where[ahead] - where <= self.shortest[item] - self.q))
        if not len(dense):
            return np.zeros((0, 6), dtype=np.int64)
        reach = where[ahead[dense]]
        g, begin = group[dense], where[dense]
        apart = np.ones(len(dense), dtype=bool)  # dense stretches of a band that touch are one region
        apart[1:] = (g[1:] != g[:-1]) | (begin[1:] > reach[:-1])
        first = np.flatnonzero(apart)
        low, high = np.minimum.reduceat(diagonal[dense], first), np.maximum.reduceat(diagonal[dense], first)
        found = np.stack([doc[dense[first]], item[dense[first]], low, high, begin[first], np.maximum.reduceat(reach, first)], axis=1)
        return np.unique(found, axis=0)  # what lies in both of two overlapping bands

    def align(self, norm: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best local alignment of each region within its band: characters matched, edits, and words of the item it covers.

        All regions advance together, one document character a step. A cell packs score, matches and edits
        into one integer, so that the larger cell is the better one; equal characters add 1 to the score, an
        edit takes 2, and a score never falls below 0.
        """
        doc, item, low, high, begin, end = found.T
        first = low - self.edits
        width = int((high - low).max()) + 1 + 2 * self.edits
        length = np.minimum(end + self.q, offsets[doc + 1] - offsets[doc]) - begin
        chars = np.append(norm, np.uint8(0))
        one, edit, score = np.int64((1 << 42) + (1 << 21)), np.int64((2 << 42) - 1), np.int64(1 << 42)
        best, last = np.zeros(len(found), dtype=np.int64), np.zeros(len(found), dtype=np.int64)
        row = np.zeros((width + 2, len(found)), dtype=np.int64)
        size = self.ends[item] - self.starts[item]
        for i in range(int(length.max())):
            live = i < length
            c = chars[np.where(live, offsets[doc] + begin + i, -1)]
            after = np.zeros_like(row)
            for d in reversed(range(width)):
                j = begin + i - first - d
                valid = live & (j >= 0) & (j < size)
                same = valid & (self.norm[np.where(valid, self.starts[item] + j, 0)] == c)
                # another character, one more in the document, one more in the item
                other = np.maximum(np.maximum(row[d + 1], row[d]), after[d + 2]) - edit
                cell = np.where(same, row[d + 1] + one, np.where(other >= score, other, 0))
                after[d + 1] = np.where(valid, cell, 0)
                better = after[d + 1] > best
                best, last = np.where(better, after[d + 1], best), np.where(better, j + 1, last)
            row = after
        matched, edits = (best >> 21) & ((1 << 21) - 1), best & ((1 << 21) - 1)
        words = [self._covered(i, e - m - k - self.edits, e + self.edits) for i, e, m, k in zip(item.tolist(), last.tolist(), matched.tolist(), edits.tolist())]
        return matched, edits, np.array(words, dtype=np.int64)

    def _covered(self, i: int, first: int, last: int) -> int:
        """Words of item i that lie between two of its positions."""
        begin, end = self.spans[i]
        return max(0, int(np.searchsorted(end, last, side="right") - np.searchsorted(begin, first, side="left")))

    def word_run(self, doc: str, i: int, begin: int, end: int) -> int:
        """Length of the longest run of words of item i inside doc[begin:end], widened to whole words; 0 below ``passage``."""
        a = doc.rfind(" ", 0, max(0, begin)) + 1
        b = doc.find(" ", end)
        w = doc[a : b if b >= 0 else len(doc)].split()
        own, best = self.runs[i], 0
        k = 0
        while k + self.passage <= len(w):
            if tuple(w[k : k + self.passage]) in own:
                n = self.passage
                text = " " + self.texts[i] + " "
                while k + n < len(w) and " " + " ".join(w[k : k + n + 1]) + " " in text:
                    n += 1
                best = max(best, n)
                k += n - self.passage + 1
            else:
                k += 1
        return best


_built: dict[str, ItemIndex] = {}


def _index(name: str, shared) -> ItemIndex:
    """The index of a broadcast block, built once in a worker."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemIndex(*shared.value)
    return _built[name]


def _search(shared):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch, texts in text_slices(batches, "text", 4_000_000):
            norm, off = normal_text(texts)
            found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
            strings: dict[int, str] = {}
            regions = index.regions(norm, off)
            if len(regions):
                regions = regions[np.argsort(regions[:, 5] - regions[:, 4], kind="stable")]
                parts = [index.align(norm, off, r) for r in np.array_split(regions, min(8, len(regions)))]
                matched, edits, covered = (np.concatenate(x) for x in zip(*parts))
                ok = matched >= index.shortest[regions[:, 1]] - index.edits
                for (d, i, _, _, begin, end), m, e, c in zip(regions[ok].tolist(), matched[ok].tolist(), edits[ok].tolist(), covered[ok].tolist()):
                    if d not in strings:
                        strings[d] = norm[off[d] : off[d + 1]].tobytes().decode("ascii")
                    words = index.word_run(strings[d], i, begin, end + index.q)
                    found[d, i] = max(found.get((d, i), (0, 0, 0, 0)), (words, c, m, -e))
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([d for d, _ in keys], type=pa.int64())),
                    pa.array([index.ids[i] for _, i in keys], type=index_type(index.ids)),
                    *[pa.array([sign * found[k][n] for k in keys], type=pa.int32()) for n, sign in ((2, 1), (3, -1), (1, 1), (0, 1))],
                ],
                names=["doc_id", "item_id", "matched_chars", "edits", "words", "word_run"],
            )

    return run


def index_type(ids: list) -> pa.DataType:
    return pa.string() if ids and isinstance(ids[0], str) else pa.int64()


def leaks(docs: DataFrame, items: DataFrame, *, q: int = Q, edits: int = EDITS, passage: int = PASSAGE) -> DataFrame:
    """Regions of documents that hold a passage of an item: ``(doc_id, item_id, matched_chars, edits, words, word_run)``.

    A passage is as long as the item's shortest one of ``passage`` words and may hold ``edits`` edits. One row for each
    document and item, that of the longest run. ``words`` is the number of the item's words that the alignment covers; ``word_run`` is the number of consecutive words
    shared exactly, 0 below ``passage``. Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters
    (measured, not assumed); more items mean more passes over the corpus. Repeated ids count once each with their
    own text; null texts, ids and items of fewer than ``passage`` words give no row; empty tables an empty result.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    held = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((text, "doc_id"), (held, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, matched_chars int, edits int, words int, word_run int"
    parts = []
    for b in range(blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows], q, edits, passage))
        parts.append(text.mapInArrow(_search(shared), schema))
    best = F.max(F.struct("word_run", "words", "matched_chars", (-F.col("edits")).alias("e"))).alias("m")
    return (
        reduce(DataFrame.union, parts)
        .groupBy("doc_id", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "m.matched_chars", (-F.col("m.e")).alias("edits"), "m.words", "m.word_run")
    )
