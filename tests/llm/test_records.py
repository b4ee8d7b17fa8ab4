"""Near duplicates, leaks, neighbours and mixing against brute force, with odd rows."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import leakage, mixing, queries
from millrace.llm import near_duplicates as nd
from millrace.llm import neighbours as nn

WORDS = [f"w{i}" for i in range(400)] + ["été", "中文", "a_b", "X"]


def shingles(t):
    w = re.findall(r"\w+", t or "")
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def alike(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.6 * len(sets[a] | sets[b]):
            out.add((a, b))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(80)]
        for k in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((i * 10 + k, rng.choice([" ", "\r\n", ", "]).join(w)))
    rows += [(9001, None), (9002, ""), (9003, "one two"), (None, "x y z"), (9004, "p q r s"), (9005, "p q r s"), rows[0]]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "chunk_id long, content string, id int, rep int, sig string")
    members, links = nd.near_duplicates(df)
    got = {tuple(r) for r in nd.similar_pairs(members, links).collect()}
    assert got == alike(rows)
    groups = {r["id"]: r["group_id"] for r in nd.groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in got) and groups[9004] == groups[9005] == 9004


def test_large_copy_group_is_a_star(spark):
    df = spark.createDataFrame([(i, "same text of five words") for i in range(100)], "chunk_id long, content string")
    members, links = nd.near_duplicates(df)
    assert {tuple(r) for r in nd.similar_pairs(members, links).collect()} == {(0, i) for i in range(1, 100)}
    assert members.count() == 100 and links.count() == 0


def test_near_duplicates_of_nothing(spark):
    members, links = nd.near_duplicates(spark.createDataFrame([], "chunk_id long, content string"))
    assert nd.similar_pairs(members, links).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(200)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)] + [(90, None), (91, "short"), (92, "")]
    docs = []
    for d in range(120):
        w = [rng.choice(words) for _ in range(60)]
        if d % 3 == 0:
            source = items[rng.randrange(20)][1].split()
            n, at = rng.randint(9, 20), rng.randrange(20)
            w[20:20] = source[at : at + n]
        docs.append((d, rng.choice([" ", "-- ", "\n"]).join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (None, "x"), (502, "é " + items[0][1] + " ü"), (503, items[1][1] * 200)]
    grams = {}
    word = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    for i, t in items:
        for k in range(len(word(t)) - 11):
            grams.setdefault(tuple(word(t)[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for k in range(len(word(t)) - 11) for i in grams.get(tuple(word(t)[k : k + 12]), ())}
    D = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    I = spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(D, I).where("word_run >= 12").collect()}
    assert got == want and len(want) > 20
    assert leakage.leaks(D.limit(0), I).count() == 0 and leakage.leaks(D, I.limit(0)).count() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 64))
    rows = []
    for i in range(900):
        v = centres[i % 60] + 0.15 * rng.standard_normal(64)
        rows.append((f"r{i:04d}", i % 2, (v * rng.uniform(0.1, 9)).astype(float).tolist()))
    rows += [("zero", 0, [0.0] * 64), ("none", 0, None), ("few", 0, [1.0]), (None, 0, [1.0] * 64), ("nan", 1, [float("nan")] * 64), ("nl", None, [1.0] * 64), rows[5]]
    rows += [(f"copy{i:02d}", 1, [float(i == 3)] * 0 + [1.0] * 64) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "id string, level int, embedding array<float>, node int, rank string")
    got = {}
    for r in nn.neighbours(df, 5, degree=12, cuttings=6, rounds=2).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    good, hits, total = {r[0]: r for r in rows if r[0] and r[1] is not None and r[2] and len(r[2]) == 64 and any(r[2]) and r[2][0] == r[2][0]}, 0, 0
    for level in (0, 1):
        ids = sorted(i for i, r in good.items() if r[1] == level)
        x = np.array([good[i][2] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i, o in zip(ids, np.argsort(-s, axis=1, kind="stable")[:, :5]):
            hits += len({ids[j] for j in o} & got[i]) if not i.startswith("copy") else 0
            total += 5 * (not i.startswith("copy"))
    assert hits / total > 0.95
    assert got["copy00"] == {f"copy{i:02d}" for i in range(1, 6)} and got["copy11"] == {f"copy{i:02d}" for i in range(5)}
    assert set(got) == set(good)
    assert nn.neighbours(df.limit(0), 5).count() == 0


def test_graph_search(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 64)).astype(float)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, level int, embedding array<float>")
    members, nodes = nn.prepare(df)
    links = nn.graph(nodes, degree=16, cuttings=4, rounds=2)
    asked = members.where("id % 20 = 0").join(nodes, "node").select(F.col("id").alias("qid"), "level", "code")
    found = nn.search(nodes, links, asked, 6).join(members, "node").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in found:
        got.setdefault(r["qid"], set()).add(r["id"])
    hits = sum(len(got[q] & set(np.argsort(-(u @ u[q]))[:6].tolist())) for q in range(0, 600, 20))
    assert len(got) == 30 and hits / 180 >= 0.9


def test_mixing(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice(["a", "a", "a", "b", "b", "c"]), "word " * rng.randint(5, 60)) for i in range(3000)]
    docs += [(9001, "a", None), (9002, "b", ""), (9003, None, "x"), (None, "a", "x"), docs[0]]
    df = spark.createDataFrame([(*d, 5, "m") for d in docs], "doc_id long, source string, text string, tokens int, mix_name string")
    mix = [("m", "a", 2.0, 1.0), ("m", "b", 1.0, 4.0), ("m", "c", 1.0, 2.0), ("m", "empty", 1.0, 3.0), ("m", None, 1.0, 1.0), ("n", "b", 0.5, None), ("n", "b", 0.5, None)]
    targets = spark.createDataFrame(mix, "mix_name string, source string, target_share double, max_repeat double")
    drawn, report = mixing.mixed(df, targets)
    rows = {(r["mix_name"], r["source"]): r for r in report.collect()}
    assert rows["m", "empty"]["drawn_tokens"] == 0 and rows["n", "b"]["actual_share"] == 1.0
    assert rows["m", "c"]["rate"] <= 2.0 and rows["m", "a"]["rate"] <= 1.0
    for (m, s), r in rows.items():
        if r["tokens"]:
            assert r["drawn_tokens"] == pytest.approx(r["rate"] * r["tokens"], rel=0.08)
    most = drawn.groupBy("mix_name", "source", "doc_id").count().groupBy("mix_name", "source").agg(F.max("count").alias("n")).collect()
    assert all(r["n"] <= np.ceil(rows[r["mix_name"], r["source"]]["rate"]) for r in most)
    again = mixing.mixed(df.repartition(7), targets)[0]
    key = ["mix_name", "doc_id", "copy"]
    assert {tuple(r) for r in drawn.select(key).collect()} == {tuple(r) for r in again.select(key).collect()}
    assert mixing.mixed(df.limit(0), targets)[0].count() == 0 and mixing.mixed(df, targets.limit(0))[1].count() == 0


def test_pairs_in_a_dense_cluster(spark, tmp_path):
    """A third of a level in one cluster (median cosine 0.92), too large for a block."""
    rng = np.random.default_rng(3)
    n, hot = 30_000, 10_000
    x = rng.standard_normal((n, 64))
    x[:hot] = 8 * x[0] / np.linalg.norm(x[0]) + 0.295 * rng.standard_normal((hot, 64))
    spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "level": 0, "embedding": list(x.astype(np.float32))})).write.parquet(str(tmp_path / "index_record.parquet"))
    u = x[:hot].astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(min(i, j), max(i, j)) for i, best in enumerate(np.argpartition(-s, 5, axis=1)[:, :5].tolist()) for j in best if s[i, j] >= 0.901}
    got = {tuple(r) for r in queries.p6_found(spark, str(tmp_path)).collect()}
    assert len(want) > 2 * hot and len(want & got) / len(want) > 0.93


def test_a_long_chain_is_one_group(spark):
    members = spark.range(300).selectExpr("id", "id AS rep", "1L AS copies")
    links = spark.range(299).selectExpr("id AS a", "id + 1 AS b", "0.7D AS jaccard")
    assert {r["group_id"] for r in nd.groups(members, links).collect()} == {0}


def test_long_posting_lists_are_joined_in_parts(spark, monkeypatch):
    """A third of all texts share most of their content, so that one value of a coordinate is in all of them."""
    rng = random.Random(8)
    stock = " ".join(rng.choice(WORDS) for _ in range(30))
    rows = [(i, stock + f" {i} {rng.choice(WORDS)} " + " ".join(rng.choice(WORDS) for _ in range(rng.choice([2, 40])))) for i in range(120)]
    rows += [(1000 + i, " ".join(rng.choice(WORDS) for _ in range(40))) for i in range(240)]
    df = spark.createDataFrame(rows, "chunk_id long, content string")
    want = alike(rows)
    monkeypatch.setattr(nd, "LIST", 7)
    members, links = nd.near_duplicates(df)
    assert {tuple(r) for r in nd.similar_pairs(members, links).collect()} == want and len(want) > 500


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
def test_alignment_decides_on_edited_passages(spark, kind):
    """A passage with one edit in its middle is found by the alignment alone, one with edits all over is not."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(14))) for i in range(30)]

    def damaged(text, at):
        for p in sorted(at, reverse=True):
            text = text[:p] + {"substitute": "z", "insert": "z" + text[p], "delete": ""}[kind] + text[p + 1 :]
        return text

    docs, want = [], set()
    for i, text in items:
        few, many = damaged(text, [len(text) // 2]), damaged(text, range(5, len(text), 9))
        assert edit_distance(text, few) == 1 and edit_distance(text, many) > 5
        docs += [(i, f"{word()} {few} {word()}"), (100 + i, f"{word()} {many} {word()}")]
        want.add((i, i))
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaks(D, I).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and all(r["word_run"] < 12 and r["edits"] == 1 for r in found)


def test_many_postings_are_taken_in_turns(spark, monkeypatch):
    rng = random.Random(9)
    stock = " ".join(f"s{i}" for i in range(15))
    items = spark.createDataFrame([(i, f"{stock} u{i}") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"v{d} {stock} " * rng.randint(1, 3)) for d in range(30)] + [(99, "nothing of it")], "doc_id long, text string")
    monkeypatch.setattr(leakage, "_HITS", 1000)
    assert leakage.leaks(docs, items).where("word_run >= 12").count() == 30 * 40
