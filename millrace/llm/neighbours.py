"""Most similar vectors for every vector: a neighbour graph by NN-descent.

The graph starts from exact neighbours inside blocks and grows by rounds, each a
few joins: every node sends its vector along its edges, forward and reverse, and
where the neighbours of a node meet they are compared with one another. An edge
takes part as new once; pairs of old edges are not compared again, and nodes
without a new edge at hand drop out, so that rounds shrink as the graph settles.
Vectors travel as signed bytes, of which products are exact; what the graph
finds is compared once more with full precision. Equal vectors form one node, so
that copies cost nothing and never fill a block.

Blocks are cells of random hyperplanes, in several independent cuttings. A cell
that is too large is cut once more by hyperplanes through its middle, which
divides a dense cluster by place; what is still too large is divided by hash.

Queries that are no nodes walk the graph greedily from a few entry nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text_kernels import list_column
from millrace.session import staged, unstage

DIMENSIONS = 64
BLOCK, CUTTINGS, DEGREE, ROUNDS = 512, 10, 12, 8
LARGE = 2048  # nodes of a cell that is cut again, and about the size of its parts
SAMPLE = 10  # edges of a node that take part in a round, forward; as many, on average at most, reverse
TOLD = 4  # better pairs that one meeting of neighbours reports for each of them
SALTS = 64
PLANES = 40
TOGETHER = 8  # cuttings


def usable(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Vectors of the right length that are not all zero and hold no null, NaN or infinity."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == dimensions) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True)) if n else v
        q = np.rint(v * (127 / np.abs(v).max(axis=1, keepdims=True))).astype(np.int8) if n else v.astype(np.int8)
        unit = np.ascontiguousarray(v.astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([r.tobytes() for r in unit], type=pa.binary()),
                pa.array([r.tobytes() for r in q], type=pa.binary()),
            ],
            names=["id", "level", "unit", "code"],
        )


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers behind a column of byte codes, and one over their lengths."""
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int8).reshape(len(column), -1).astype(np.float32)
    return data, 1 / np.sqrt(np.maximum((data * data).sum(axis=1), 1)).astype(np.float32)


def _cosines(v: np.ndarray, r: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Equal for a pair in both directions: the products of whole numbers are exact."""
    return (v @ w.T) * (r[:, None] * q[None, :])


@lru_cache(maxsize=256)
def _planes(seed: int, cutting: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng((seed, cutting)).standard_normal((PLANES, dimensions)).astype(np.float32)


def _cells(bits: dict[int, int], cuttings: range, seed: int, codes: bool):
    """``(node, level, cell[, code])``, a row for each cutting: the sides of its first hyperplanes on which a node lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v, _ = _unpack(batch.column(2))
            width = np.array([bits.get(x, 0) for x in batch.column(1).to_pylist()])
            used = int(width.max())
            for t in cuttings:
                signs = (v @ _planes(seed, t, v.shape[1])[:used].T > 0).astype(np.int64) << np.arange(used)
                signs[np.arange(used)[None, :] >= width[:, None]] = 0
                columns = [batch.column(0), batch.column(1), pa.array(signs.sum(axis=1) << 10 | t), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns if codes else columns[1:3], names=["node", "level", "cell", "code"] if codes else ["level", "cell"])

    return run


def _along(code: pa.Array, cell: pa.Array, seed: int, width: int) -> np.ndarray:
    """The vectors' extent along ``width`` further directions, others in each cutting."""
    v, r = _unpack(code)
    cut = cell.to_numpy() & 1023
    out = np.empty((len(v), width), dtype=np.float32)
    for t in np.unique(cut).tolist():
        out[cut == t] = (v[cut == t] * r[cut == t][:, None]) @ _planes(seed + 1, t, v.shape[1])[:width].T
    return out


def _projections(seed: int, width: int):
    """Rows ``(level, cell, code)`` of large cells to ``(level, cell, p0, p1, ...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = _along(batch.column(2), batch.column(1), seed, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(side[:, i]) for i in range(width)]], names=["level", "cell", *[f"p{i}" for i in range(width)]])

    return run


def _halves(seed: int):
    """Rows ``(node, level, cell, code, parts, middle)`` of large cells to ``(node, level, cell, code, part)``: on which sides of the middle a node lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                middle = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                side = (_along(batch.column(3), batch.column(2), seed, middle.shape[1]) > middle).astype(np.int64) << np.arange(middle.shape[1])
                side[np.arange(middle.shape[1])[None, :] >= batch.column(4).to_numpy(zero_copy_only=False)[:, None]] = 0
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(side.sum(axis=1))], names=["node", "level", "cell", "code", "part"])

    return run


def _ranked(node: np.ndarray, to: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best distinct edges of each node, best first; the first of equal pairs counts."""
    order = np.lexsort((to, -sim, node))
    node, to, sim = node[order], to[order], sim[order]
    same = np.lexsort((np.arange(len(to)), to, node))
    again = np.zeros(len(to), dtype=bool)
    again[same[1:]] = (node[same[1:]] == node[same[:-1]]) & (to[same[1:]] == to[same[:-1]])
    node, to, sim, order = node[~again], to[~again], sim[~again], order[~again]
    first = np.searchsorted(node, node, side="left")
    keep = np.arange(len(node)) - first < most
    return node[keep], to[keep], order[keep]


def _inside(degree: int, floor: float):
    """Exact neighbours inside a block: ``(node, to, sim)`` with lists."""

    def run(block: pa.Table) -> pa.Table:
        nodes = block.column("node").to_numpy()
        v, r = _unpack(block.column("code").combine_chunks())
        heads, sizes, tos, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        k = min(degree, len(nodes) - 1)
        for a in range(0, len(nodes) if k > 0 else 0, 2048):
            s = _cosines(v[a : a + 2048], r[a : a + 2048], v, r)
            s[np.arange(len(s)), a + np.arange(len(s))] = -2
            rows = np.flatnonzero((s >= floor).any(axis=1)) if floor > -1 else np.arange(len(s))  # most rows have nothing above a floor
            best = np.argpartition(-s[rows], k - 1, axis=1)[:, :k]
            x = np.take_along_axis(s[rows], best, axis=1)
            keep = x >= floor
            heads.append(nodes[a + rows])
            sizes.append(keep.sum(axis=1))
            tos.append(nodes[best][keep])
            sims.append(x[keep])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.table([pa.array(np.concatenate(heads)), list_column(np.concatenate(tos), offsets, pa.int64()), list_column(np.concatenate(sims), offsets, pa.float32())], names=["node", "to", "sim"])

    return run


def _settle(degree: int):
    """Rows ``(node, code, to, sim, told)``, lists of lists, to ``(node, code, to, sim, fresh)``: the best edges, and for each
    whether it is old (0), new (1) or new with more than a round takes before it (2).

    ``told`` says for each list whether its edges are new; an edge that is in both is old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists, values = batch.column(2), batch.column(3)
            per_list = np.diff(lists.flatten().offsets.to_numpy())
            per_row = np.diff(lists.offsets.to_numpy())
            node = np.repeat(np.repeat(np.arange(n), per_row), per_list)
            told = np.repeat(batch.column(4).flatten().to_numpy(zero_copy_only=False), per_list).astype(bool)
            to, sim = lists.flatten().flatten().to_numpy(), values.flatten().flatten().to_numpy()
            old_first = np.argsort(told, kind="stable")  # an edge that was there is not new
            node, to, sim, told = node[old_first], to[old_first], sim[old_first], told[old_first]
            node, to, at = _ranked(node, to, sim, degree)
            offsets = np.searchsorted(node, np.arange(n + 1))
            new = told[at]
            count = np.cumsum(new)
            nth = count - np.concatenate([[0], count])[offsets[:-1]][node]
            fresh = np.where(new, 1 + (nth > SAMPLE), 0).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), list_column(to, offsets, pa.int64()), list_column(sim[at], offsets, pa.float32()), list_column(fresh, offsets, pa.int8())],
                names=["node", "code", "to", "sim", "fresh"],
            )

    return run


def _meet(floor: float):
    """Rows ``(members, fresh, worst, code)``, lists of the neighbours of one node, to ``(node, to, sim)``: pairs of them of
    which one is new, where they beat the worst edge of the first; the best few for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            nodes, fresh, worst = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3))
            if not len(nodes):
                continue
            v, r = _unpack(batch.column(3).flatten())
            heads, sizes, tos, sims = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                new = fresh[a:b]
                if b - a < 2 or not new.any():
                    continue
                s = _cosines(v[a:b], r[a:b], v[a:b], r[a:b])
                s[(nodes[a:b][:, None] == nodes[a:b][None, :]) | ~(new[:, None] | new[None, :]) | (s < floor) | (s <= worst[a:b][:, None])] = -2
                k = min(TOLD, b - a - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                x = np.take_along_axis(s, best, axis=1)
                keep = x > -2
                size = keep.sum(axis=1)
                some = np.flatnonzero(size)
                if len(some):
                    heads.append(nodes[a + some])
                    sizes.append(size[some])
                    tos.append(nodes[a + best[keep]])
                    sims.append(x[keep])
            if heads:
                at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), list_column(np.concatenate(tos), at, pa.int64()), list_column(np.concatenate(sims), at, pa.float32())], names=["node", "to", "sim"])

    return run


_EDGES = "node long, to array<long>, sim array<float>"


def _blocks(nodes: DataFrame, bits: dict[int, int], cuttings: range, seed: int) -> DataFrame:
    """``(node, level, cell, part, code)``: the block of a node in each cutting."""
    source = nodes.select("node", "level", "code")
    cells = lambda: source.mapInArrow(_cells(bits, cuttings, seed, True), "node long, level int, cell long, code binary")
    # only large cells go on; their number of halvings and the middles along these directions are a row each
    large = source.mapInArrow(_cells(bits, cuttings, seed, False), "level int, cell long").groupBy("level", "cell").count().where(F.col("count") > LARGE)
    large = staged(large.select("level", "cell", F.ceil(F.log2(F.col("count") / LARGE)).cast("int").alias("parts")), "large_cells")
    most = min(PLANES, large.agg(F.max("parts")).first()[0] or 0)
    if not most:
        return cells().withColumn("part", F.lit(0).cast("long"))
    sides = cells().join(large, ["level", "cell"]).select("level", "cell", "code").mapInArrow(_projections(seed, most), "level int, cell long, " + ", ".join(f"p{i} float" for i in range(most)))
    middle = sides.groupBy("level", "cell").agg(F.array(*[F.avg(f"p{i}").cast("float") for i in range(most)]).alias("middle"))
    middle = staged(large.join(middle, ["level", "cell"]), "middles")
    halved = lambda: cells().join(middle, ["level", "cell"]).select("node", "level", "cell", "code", "parts", "middle").mapInArrow(_halves(seed), "node long, level int, cell long, code binary, part long")
    still = halved().groupBy("level", "cell", "part").count().where(F.col("count") > 2 * LARGE)
    still = staged(still.select("level", "cell", "part", F.ceil(F.col("count") / LARGE).alias("shares")), "large_parts")
    share = F.pmod(F.xxhash64("node", "cell", "part"), F.coalesce("shares", F.lit(1)))
    dense = halved().join(still, ["level", "cell", "part"], "left").select("node", "level", "cell", F.xxhash64("part", share).alias("part"), "code")
    return cells().join(large, ["level", "cell"], "left_anti").select("node", "level", "cell", F.lit(0).cast("long").alias("part"), "code").union(dense)


def graph(nodes: DataFrame, *, degree: int, cuttings: int, rounds: int, floor: float = -1.0, seed: int = 7) -> DataFrame:
    """``(node, to, sim)`` with lists, best first, over staged ``nodes(node, level, code)``: NN-descent from block neighbours.

    Edges below ``floor`` are not kept. It ends when a round changes less than 0.1 % of the edges, or after ``rounds``.
    """
    counts = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # a few levels
    bits = {level: max(0, min(PLANES, int(np.ceil(np.log2(max(1, n / BLOCK)))))) for level, n in counts.items()}
    # a few cuttings at a time, so that no more copies of the vectors are on the way at once
    near = [
        staged(_blocks(nodes, bits, range(t, min(t + TOGETHER, cuttings)), seed).groupBy("level", "cell", "part").applyInArrow(_inside(degree, floor), _EDGES), "near")
        for t in range(0, cuttings, TOGETHER)
    ]
    codes = nodes.select("node", "code", F.lit(None).cast("array<long>").alias("to"), F.lit(None).cast("array<float>").alias("sim"), F.lit(False).alias("told"))

    def settled(parts: DataFrame) -> DataFrame:
        rows = parts.groupBy("node").agg(F.max("code").alias("code"), F.collect_list("to").alias("to"), F.collect_list("sim").alias("sim"), F.collect_list(F.when(F.col("to").isNotNull(), F.col("told"))).alias("told"))
        return staged(rows.select("node", "code", "to", "sim", "told").mapInArrow(_settle(degree), f"node long, code binary, to array<long>, sim array<float>, fresh array<tinyint>"), "graph")

    lists = lambda df, told: df.select("node", F.lit(None).cast("binary").alias("code"), "to", "sim", F.lit(told).alias("told"))
    current = settled(reduce(DataFrame.union, [codes, *[lists(n, True) for n in near]]))
    for n in near:
        unstage(n)
    for turn in range(rounds):
        worst = F.when(F.size("sim") >= degree, F.element_at("sim", -1)).otherwise(-1.0).cast("float")
        # of a node's edges the new ones come first, as many as a round takes
        all_ = F.transform("to", lambda t, i: F.struct((F.get("fresh", i) == 0).alias("old"), i.alias("i"), t.alias("to"), F.get("fresh", i).alias("fresh")))
        edges = F.slice(F.sort_array(F.filter(all_, lambda e: e["fresh"] < 2)), 1, SAMPLE)
        sent = current.select("node", "code", worst.alias("worst"), F.explode(edges).alias("e")).select("node", "code", "worst", F.col("e.to").alias("to"), (F.col("e.fresh") > 0).alias("fresh"))
        # at first every edge is new; later only nodes with a new edge at hand take part
        active = staged(sent.where("fresh").select(F.explode(F.array("node", "to")).alias("centre")).distinct(), "active") if turn else None
        awake = lambda links: links if active is None else links.join(active, "centre", "left_semi")
        # reverse links of a node that many have are sampled to the same number, by hash: no node gathers more
        hubs = sent.groupBy("to").agg(F.count("*").alias("into")).where(F.col("into") > SAMPLE)
        chance = F.pmod(F.xxhash64("node", "to", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        back = sent.join(hubs, "to", "left").where(F.col("into").isNull() | (chance < SAMPLE / F.col("into"))).select(F.col("to").alias("centre"), F.col("node").alias("member"), "fresh", "worst", "code")
        known = current.select(F.col("node").alias("member"), worst.alias("worst"), "code")
        ahead = sent.select(F.col("node").alias("centre"), F.col("to").alias("member"), "fresh")
        ahead = awake(ahead).join(known, "member").select("centre", "member", "fresh", "worst", "code")
        met = ahead.union(awake(back)).groupBy("centre").agg(*[F.collect_list(c).alias(c) for c in ("member", "fresh", "worst", "code")])
        found = staged(met.select("member", "fresh", "worst", "code").mapInArrow(_meet(floor), _EDGES), "found")
        part = lambda waits: [F.filter(c, lambda x, i: (F.get("fresh", i) == 2) == waits).alias(c) for c in ("to", "sim")]
        own = current.select("node", "code", *part(F.lit(False)), F.lit(False).alias("told"))
        waiting = current.where(F.array_contains("fresh", F.lit(2).cast("tinyint"))).select("node", F.lit(None).cast("binary").alias("code"), *part(F.lit(True)), F.lit(True).alias("told"))
        after = settled(own.union(waiting).union(lists(found, True)))
        fresh, total = after.agg(F.sum(F.size(F.filter("fresh", lambda x: x > 0))), F.sum(F.size("to"))).first()
        for old in (current, found, *[active] * (active is not None)):
            unstage(old)
        current = after
        if (fresh or 0) <= 0.001 * (total or 0):
            break
    return current.select("node", "to", "sim")


def _exact(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with their cosine in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.float32).reshape(batch.num_rows, -1).astype(np.float64) for i in (2, 3))
            cosine = (x * y).sum(axis=1) / np.maximum(np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), 1e-30) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    x = units.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
    y = units.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long, cosine double")


def prepare(records: DataFrame, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """``members(id, node)`` and staged ``nodes(node, level, unit, code)``: one node for each distinct vector of a level."""
    wanted = records.select("id", F.col("level").cast("int").alias("level"), "embedding").where(F.col("id").isNotNull() & F.col("level").isNotNull() & usable(F.col("embedding"), dimensions))
    kind = wanted.schema["id"].dataType.simpleString()
    coded = wanted.mapInArrow(_encode, f"id {kind}, level int, unit binary, code binary")
    hashed = coded.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")})
    one = hashed.groupBy("id").agg(F.min_by(F.struct("level", "unit", "code", "h1", "h2"), F.struct("level", "h1", "h2")).alias("r")).select("id", "r.*")
    once = staged(one.withColumn("row", F.monotonically_increasing_id()), "vectors")
    heads = once.groupBy("level", "h1", "h2").agg(F.min("row").alias("node"))
    members = once.select("id", "level", "h1", "h2").join(heads, ["level", "h1", "h2"]).select("id", "node")
    nodes = once.join(heads.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "level", "unit", "code")
    members, nodes = staged(members, "members"), staged(nodes, "nodes")
    unstage(once)
    return members, nodes


def neighbours(
    records: DataFrame, k: int = 5, *, min_cosine: float | None = None, degree: int = DEGREE, cuttings: int = CUTTINGS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS
) -> DataFrame:
    """The ``k`` most similar other records of the same level: ``(id, neighbour, cosine, rank)``.

    ``records(id, level, embedding)``; rows whose vector is null, of another length or all zero, and rows without
    id or level, are left out; a repeated id counts once (of unlike rows that of the lowest level). Ties in cosine go to the smaller id.
    With ``min_cosine`` only neighbours at or above it are asked for, which lets the graph leave out edges far below.
    Other columns are not read; an empty table gives an empty result.
    """
    members, nodes = prepare(records, dimensions)
    floor = -1.0 if min_cosine is None else min_cosine - 0.25
    found = graph(nodes, degree=max(degree, k + 3), cuttings=cuttings, rounds=rounds, floor=floor)
    near = found.select(F.col("node").alias("a"), F.explode(F.arrays_zip("to", "sim")).alias("e")).where(F.col("e.sim") >= (-1.0 if min_cosine is None else min_cosine - 0.03))
    pairs = _exact(near.select("a", F.col("e.to").alias("b")), nodes)
    if min_cosine is not None:
        pairs = pairs.where(F.col("cosine") >= min_cosine)
    # of a class of equal vectors the k + 1 smallest ids can be neighbours; found in two steps, the first salted
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    least = members.groupBy("node", salt.alias("s")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    least = least.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    own = members.join(least, "node").where(F.size("ids") > 1).select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    other = (
        members.join(pairs.withColumnRenamed("a", "node"), "node")
        .join(least.withColumnRenamed("node", "b"), "b")
        .select("id", F.explode("ids").alias("neighbour"), "cosine")
    )
    every = own.where("id <> neighbour").union(other)
    top = every.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))), 1, k).alias("top"))
    return top.select("id", F.posexplode("top").alias("at", "t")).select("id", F.col("t.neighbour").alias("neighbour"), (-F.col("t.c")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _rowwise(a: pa.Array, b: pa.Array) -> np.ndarray:
    (x, p), (y, q) = _unpack(a), _unpack(b)
    return ((x * y).sum(axis=1) * (p * q)).astype(np.float32)


def search(nodes: DataFrame, links: DataFrame, queries: DataFrame, k: int = 5, *, beam: int = 24, entries: int = 16) -> DataFrame:
    """Greedy search of the graph ``links(node, to, sim)`` for ``queries(qid, level, code)``: ``(qid, node, sim)``, k rows a query.

    Every query starts at ``entries`` nodes of its level, drawn by hash, and keeps a beam; each step visits the
    neighbours of what the beam has not expanded yet, until no query has such a node: beams only get better, so it ends.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _rowwise(batch.column(2), batch.column(3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["qid", "node", "sim"])

    kind = queries.schema["qid"].dataType.simpleString()
    scored = lambda pairs: pairs.select("qid", "node", "qcode", "code").mapInArrow(score, f"qid {kind}, node long, sim float")
    asked = queries.select("qid", "level", F.col("code").alias("qcode"))
    ranked = nodes.select("level", "node", "code", F.xxhash64("node").alias("h"))
    start = ranked.groupBy("level").agg(F.min_by(F.struct("node", "code"), "h").alias("e0"), *[F.min_by(F.struct("node", "code"), F.xxhash64("h", F.lit(i))).alias(f"e{i}") for i in range(1, entries)])
    start = start.select("level", F.explode(F.array(*[F.col(f"e{i}") for i in range(entries)])).alias("e")).select("level", "e.node", "e.code").distinct()
    beamed = staged(scored(asked.join(F.broadcast(start), "level")).withColumn("open", F.lit(True)), "beam")  # entries x levels rows
    while beamed.where("open").limit(1).count():
        # all of one query's rows: at most beam x (degree + 1)
        front = beamed.where("open").join(links, "node").select("qid", F.explode("to").alias("node")).distinct()
        fresh = front.join(beamed.select("qid", "node"), ["qid", "node"], "left_anti")
        visited = scored(fresh.join(asked, "qid").join(nodes.select("node", "code"), "node")).withColumn("open", F.lit(True))
        rows = beamed.withColumn("open", F.lit(False)).union(visited)
        top = rows.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "node", "open")), asc=False), 1, beam).alias("top"))
        after = staged(top.select("qid", F.explode("top").alias("t")).select("qid", "t.node", "t.sim", "t.open"), "beam")
        unstage(beamed)
        beamed = after
    best = beamed.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "node")), asc=False), 1, k).alias("top"))
    return best.select("qid", F.explode("top").alias("t")).select("qid", "t.node", "t.sim")
