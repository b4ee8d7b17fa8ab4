"""Cutting oversized texts at natural boundaries.

Each position of a text has a boundary strength. A piece that begins at ``s``
may end anywhere in a window of permissible lengths; a sparse table (range
maximum over strengths, O(1) a query) gives the strongest cut of the window and
breaks ties to the right. The next piece begins ``overlap`` characters before
the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
_BLOCK = 1 << 18

_DEFINES = re.compile(
    r"^[ \t]*(?:(?:export|default|declare|pub|static|final|public|private|protected|async|abstract|unsafe|const)\s+)*"
    r"(?:def|class|function|func|fn|interface|struct|enum|trait|type|impl|record)\s+(?:\([^)\n]*\)\s*)?([A-Za-z_$][\w$]*)",
    re.M,
)
_LINE_END = re.compile(r"\n")


def strengths(text: str) -> np.ndarray:
    """For each position 0..n how good a cut before it is: 5 before a definition after a blank line, 4 after a
    blank line, 3 before a definition or an unindented line, 2 after any line break, 1 after white space, else 0;
    -1 between the two halves of a line break or before a combining mark."""
    n = len(text)
    s = np.zeros(n + 1, dtype=np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (codes == 32) | (codes == 9) | (codes == 0x3000)
    s[1:][space] = 1
    s[1:][np.isin(codes, np.array([0x3002, 0xFF01, 0xFF1F, 0xFF0C, 0x3B], dtype=np.uint32))] = 1
    breaks = np.flatnonzero(codes == 10)
    s[breaks + 1] = 2
    follow = breaks + 1
    inside = follow[follow < n]
    s[inside[~np.isin(codes[inside], np.array([32, 9, 10, 13, 125, 41], dtype=np.uint32))]] = 3
    starts = np.array([m.start() for m in _DEFINES.finditer(text)], dtype=np.int64)
    s[starts[starts > 0]] = 3
    blank = np.array([m.end() for m in re.finditer(r"\n[ \t\r]*(?=\n)", text)], dtype=np.int64) + 1
    blank = blank[blank <= n]
    define = np.zeros(n + 1, dtype=bool)
    define[starts] = True
    s[blank] = np.where(define[blank], 5, 4)
    s[np.flatnonzero((codes[:-1] == 13) & (codes[1:] == 10)) + 1] = -1
    marks = np.flatnonzero(((codes >= 0x300) & (codes < 0x370)) | ((codes >= 0xFE00) & (codes < 0xFE10)) | (codes == 0x200D))
    s[marks] = -1
    return s


class RangeMax:
    """A sparse table over ``values``: ``rightmost(lo, hi)`` is the last index of the maximum in lo..hi."""

    def __init__(self, values: np.ndarray, longest: int):
        n = len(values)
        self.span = n
        level = (values + 1) * n + np.arange(n)  # the value first, then the position
        self.levels = [level]
        width = 1
        while 2 * width <= min(longest, n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def rightmost(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        return int(max(row[lo], row[hi - (1 << k) + 1])) % self.span


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begin and end of each piece. Every piece has at most ``limit`` characters and, but for the last, ends at the
    strongest boundary between half the limit and the limit; it begins ``overlap`` characters before the last end."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be smaller than half the limit")
    n, at, pieces = len(text), 0, []
    if n <= limit:
        return [(0, n)] if n else []
    s = strengths(text)
    base, table = 0, None
    while n - at > limit:
        lo, hi = at + max(overlap + 1, limit // 2), at + limit
        if table is None or hi >= base + table.span:
            base = at
            table = RangeMax(s[base : base + max(_BLOCK, 2 * limit)], limit)
        end = base + table.rightmost(lo - base, hi - base)
        pieces.append((at, end))
        at = end - overlap
        if 0 < at < n and s[at] == -1 and at + 1 < end:
            at += 1  # never begin inside a line break
    pieces.append((at, n))
    return pieces


def _split(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, text, first, symbol in zip(frame["chunk_id"], frame["content"], frame["start_line"], frame["symbol"]):
                lines = np.array([m.start() for m in _LINE_END.finditer(text)], dtype=np.int64)
                named = [(m.start(), m.group(1)) for m in _DEFINES.finditer(text)]
                heads = np.array([p for p, _ in named], dtype=np.int64)
                base = None if pd.isna(first) else int(first)
                for k, (a, b) in enumerate(cuts(text, limit, overlap)):
                    j = int(np.searchsorted(heads, a, side="right"))
                    own = named[j - 1][1] if j else symbol if isinstance(symbol, str) else (named[0][1] if named and named[0][0] < b else None)
                    rows.append(
                        (
                            key,
                            k,
                            None if base is None else base + int(np.searchsorted(lines, a)),
                            None if base is None else base + int(np.searchsorted(lines, max(a, b - 1))),
                            own,
                            a,
                            b,
                            text[a:b],
                        )
                    )
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "start_line", "end_line", "symbol", "begin", "end", "content"]).astype(
                {"start_line": "Int32", "end_line": "Int32"}
            )

    return run


def split_oversized(chunks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose ``content`` has more than ``limit`` characters (code points).

    ``(chunk_id, piece, start_line, end_line, symbol, begin, end, content)``; ``begin`` and ``end`` count
    characters of the chunk. Lines follow from the chunk's ``start_line`` and are null where that is null. The
    symbol is that of the last definition begun at or before the piece, else the chunk's own, else the first
    definition inside. Repeated deliveries of a ``chunk_id`` count once (of unlike ones the first by line). Chunks within the limit, null and empty
    contents give no row; rows without a ``chunk_id`` are left out. Other columns are not read.
    """
    long = (
        chunks.select("chunk_id", "content", F.col("start_line").cast("int").alias("start_line"), "symbol")
        .where((F.length("content") > limit) & F.col("chunk_id").isNotNull())
        .groupBy("chunk_id")
        .agg(F.min_by(F.struct("content", "start_line", "symbol"), F.struct("start_line", F.xxhash64("content", "symbol"))).alias("r"))
        .select("chunk_id", "r.*")
    )
    key = long.schema["chunk_id"].dataType.simpleString()
    schema = f"chunk_id {key}, piece int, start_line int, end_line int, symbol string, begin int, end int, content string"
    return long.mapInPandas(_split(limit, overlap), schema)
