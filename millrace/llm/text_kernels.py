"""Vectorised text kernels: whole Arrow batches are hashed with numpy, without a Python loop over tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_word_table: np.ndarray | None = None


def _series(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def is_word_table() -> np.ndarray:
    """For every code point whether it is a letter, a digit or an underscore."""
    global _word_table
    if _word_table is None:
        t = np.zeros(0x110000, dtype=bool)
        for lo, hi in ((0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xE000, 0x20000), (0x2FA1F, 0x30000), (0x323B0, 0xE0200)):
            t[lo:hi] = [chr(c).isalnum() for c in range(lo, hi)]
        for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2FA1F), (0x30000, 0x323B0)):
            t[lo:hi] = [chr(c).isalnum() for c in range(lo, hi)]
        t[ord("_")] = True
        _word_table = t
    return _word_table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a 0, and where each text starts."""
    joined = "\0".join(texts) + "\0"
    if joined.isascii():
        codes = np.frombuffer(joined.encode("ascii"), dtype=np.uint8)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    return codes, starts


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``codes[begin:end]`` for many spans at once."""
    n = len(codes)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _series("up", _BASE, n), out=prefix[1:])
    return mix((prefix[end] - prefix[begin]) * _series("down", _INVERSE, n + 1)[begin])


def word_spans(codes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each unbroken run of code points whose flag is set."""
    f = flags.view(np.int8)
    d = np.diff(f, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` successive words per text: the values, and n+1 offsets into them."""
    n = len(texts)
    codes, starts = code_points(texts)
    begin, end = word_spans(codes, is_word_table()[codes])
    if len(begin) < width:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = span_hashes(codes, begin, end)
    doc = np.searchsorted(starts, begin, side="right") - 1
    m = len(words) - width + 1
    h = np.zeros(m, dtype=np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m])
    same = doc[:m] == doc[width - 1 :]
    h, doc = h[same], doc[:m][same]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(n + 1))


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut record batches so that each has about ``chars`` characters; a longer text comes alone, whole. Null reads as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= chars):
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
