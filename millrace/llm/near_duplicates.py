"""Near-duplicate records by a signature-coordinate inverted join.

Every text is read as its set of distinct word shingles and described by a
MinHash signature of ``coordinates`` values. A text is posted under each
(coordinate, value); two texts are candidates when they collide in at least
``matches`` coordinates. Collisions are not counted by emitting all pairs of
every posting list:

* texts with the same shingle set form one class first (groups of copies, of
  whatever size, become one posting text);
* a class posts only its rarest values, as many as the match threshold leaves
  open (prefix merging: two classes with enough collisions share one of these,
  whatever the order; how frequent values are is kept in a table of fixed size);
* the long posting lists, which rank last, are skipped and probed only for the
  pairs found so far, by comparing the two signatures (skip merging);
* a list that is long all the same is joined in parts of bounded size: one side
  of it is divided by a hash, the other goes to every part.

Pairs that reach ``matches`` collisions are then checked on their whole shingle
sets. With 24 coordinates and 5 matches, a pair at the limit of 0.60 is missed
with probability 2e-5 (binomial), far less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_kernels import list_column, mix, shingle_hashes, text_slices
from millrace.session import staged, unstage

COORDINATES, MATCHES, WIDTH, SIMILARITY = 24, 5, 3, 0.60
EXPAND = 32
LIST = 1000  # postings of one part of a list
SKETCH = 1 << 16  # counters of value frequencies: half a megabyte, whatever the corpus


def _signatures(width: int, coordinates: int):
    seeds = mix(np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "content"):
            h, off = shingle_hashes(texts, width)
            full = np.flatnonzero(off[1:] > off[:-1])
            at = off[:-1][full]
            sig = np.empty((len(full), coordinates), dtype=np.uint64)
            h1 = h2 = np.zeros(0, np.uint64)
            if len(full):
                for i, seed in enumerate(seeds):
                    low = np.minimum.reduceat(mix(h ^ seed), at)
                    sig[:, i] = mix(low + seed)  # the value carries its coordinate
                h1, h2 = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(full)),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.array((off[1:] - off[:-1])[full].astype(np.int32)),
                    list_column(sig.view(np.int64).ravel(), np.arange(len(full) + 1) * coordinates, pa.int64()),
                ],
                names=["id", "h1", "h2", "n", "sig"],
            )

    return run


def _shingles(width: int, wanted):
    """Rows ``(id, h, content)`` to ``(id, shingles)``, without those whose hash falls on no bit of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, dtype=np.uint8)
        for batch in batches:
            at = np.mod(batch.column(1).to_numpy(), 8 * len(bits))
            rows = batch.take(pa.array(np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            for part, texts in text_slices([rows], "content"):
                h, off = shingle_hashes(texts, width)
                yield pa.RecordBatch.from_arrays([part.column(0), list_column(h.view(np.int64), off, pa.int64())], names=["id", "shingles"])

    return run


def _bitmap(ids: DataFrame, most: int = 1 << 27) -> bytes:
    """A bit for the hash of each id, eight bits an id and at most 16 MB: it keeps the others' texts out of a shuffle."""
    size, n = 1 << 15, ids.count()
    while size < min(most, 8 * n):
        size *= 2
    at = F.pmod(F.xxhash64("id"), F.lit(size))
    chunks = ids.select(F.floor(at / 32768).cast("int").alias("chunk"), (at % 32768).alias("at")).groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(size // 8)
    for r in chunks:
        out[r["chunk"] * 4096 : (r["chunk"] + 1) * 4096] = r["bits"]
    return bytes(out)


def _rarest(frequent, keep: int):
    """Each class posts its ``keep`` least frequent values, with the number of parts in which a list of that length is
    joined; any fixed order of values would give the same pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sig = batch.column(2).flatten().to_numpy().reshape(rows, -1)
            often = frequent.value[np.mod(sig, SKETCH)]
            order = np.lexsort((sig, often), axis=1)[:, :keep]
            at = pa.array(np.repeat(np.arange(rows), order.shape[1]))
            parts = (1 + np.take_along_axis(often, order, axis=1).ravel() // LIST).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.take_along_axis(sig, order, axis=1).ravel()), pa.array(parts), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "parts", "rep", "n"]
            )

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "content",
    *,
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the links between them.

    Returns ``members(id, rep, copies)``, with the smallest id of a class as
    ``rep``, and ``links(a, b, jaccard)`` between class representatives, a < b.
    Rows that repeat an id count once (of unlike texts under one id the closest pair counts); a text that is null, empty or shorter
    than ``width`` words has no shingle and appears in neither table. Ids may be
    of any sortable type; other columns of ``docs`` are not read. An empty table
    gives empty results.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).where("id IS NOT NULL AND content IS NOT NULL")
    id_type = text.schema["id"].dataType.simpleString()
    features = staged(
        text.mapInArrow(_signatures(width, coordinates), f"id {id_type}, h1 long, h2 long, n int, sig array<long>"), "signatures"
    )
    classes = features.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    members = staged(
        features.select("id", "h1", "h2", "n").distinct().join(classes, ["h1", "h2", "n"]).select("id", "rep", "copies", "n"), "members"
    )
    reps = staged(
        features.join(members.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("rep"), "n", "sig"),
        "representatives",
    )
    unstage(features)

    bucket = F.pmod(F.col("key"), F.lit(SKETCH)).cast("int")
    sketch = np.zeros(SKETCH, dtype=np.int64)
    for at, n in reps.select(F.explode("sig").alias("key")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect():
        sketch[at] = n
    frequent = docs.sparkSession.sparkContext.broadcast(sketch)
    prefix = reps.mapInArrow(_rarest(frequent, coordinates - matches + 1), f"key long, parts int, rep {id_type}, n int")
    fits = (F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    side = lambda rows, x, part: rows.select("key", part.alias("part"), F.col("rep").alias(x), F.col("n").alias("n" + x))
    short, long = prefix.where("parts = 1"), prefix.where("parts > 1")
    whole = F.lit(0)
    met = side(short, "a", whole).join(side(short, "b", whole), ["key", "part"]).union(
        side(long, "a", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).join(side(long, "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), ["key", "part"])
    )
    candidates = staged(met.where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct(), "candidates")
    collide = F.size(F.array_intersect("sa", "sb"))
    kept = staged(
        candidates.join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        .join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
        .where(collide >= matches)
        .select("a", "b"),
        "kept",
    )
    unstage(candidates)
    unstage(reps)
    wanted = kept.select(F.col("a").alias("id")).union(kept.select(F.col("b").alias("id"))).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(staged(wanted, "wanted")))
    sets = text.select("id", F.xxhash64("id").alias("h"), "content").mapInArrow(_shingles(width, bits), f"id {id_type}, shingles array<long>")
    both = F.size(F.array_intersect("x", "y"))
    links = staged(
        kept.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard"))
        .where(F.col("jaccard") >= similarity)
        .groupBy("a", "b")
        .agg(F.max("jaccard").alias("jaccard")),
        "links",
    )
    return members.select("id", "rep", "copies"), links


def similar_pairs(members: DataFrame, links: DataFrame, *, expand: int = EXPAND) -> DataFrame:
    """Pairs of ids ``(a, b)``, a < b, that lie in one class or in linked classes.

    Classes of up to ``expand`` copies come out pair by pair. A larger class
    comes out as a star: each copy with the representative, and the
    representative alone in pairs with other classes; ``members`` names the
    rest exactly.
    """
    shown = members.where((F.col("copies") <= expand) | (F.col("id") == F.col("rep")))
    x = shown.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    y = shown.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    between = links.select("a", "b").join(x, "a").join(y, "b").select("ia", "ib")
    small = members.where(f"copies BETWEEN 2 AND {expand}").select("id", "rep")
    within = small.select(F.col("id").alias("ia"), "rep").join(small.select(F.col("id").alias("ib"), "rep"), "rep").where("ia < ib").select("ia", "ib")
    star = members.where((F.col("copies") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("ia"), F.col("id").alias("ib"))
    return between.union(within).union(star).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """Connected groups: ``(id, group_id, links)``, one row per id; ``group_id`` is the smallest id of the group.

    Labels spread along links and are shortened by pointer jumping, each round
    written to the shared folder; it ends when no label changes, however long a chain is.
    """
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = before = staged(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("g")), "labels")
    changed = True
    while changed:
        near = edges.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        step = label.join(near, "a").select("a", F.least("g", "m").alias("n"), "g")
        far = step.join(step.select(F.col("a").alias("n"), F.col("n").alias("nn")), "n").select("a", F.col("nn").alias("n"), "g")
        after = staged(far, "labels")
        changed = after.where("n <> g").limit(1).count() > 0
        unstage(before)
        before, label = after, after.select("a", F.col("n").alias("g"))
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    return (
        members.join(label.select(F.col("a").alias("rep"), "g"), "rep", "left")
        .join(degree, "rep", "left")
        .select("id", F.coalesce("g", "rep").alias("group_id"), (F.coalesce("links", F.lit(0))).alias("links"))
    )
