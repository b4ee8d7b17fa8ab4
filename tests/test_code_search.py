"""Code search on small tables and odd rows."""

from millrace.operators import code_search as C

CHUNK = "chunk_id long, repo string, symbol string, signature string, file_path string, content string, start_line int, graph struct<calls:array<string>,imports:array<string>,extends:array<string>,contains:array<string>>"


def chunks(spark):
    g = lambda *calls: (list(calls), [], None, None)
    rows = [
        (1, "r", "publish", "publish(a)", "bus/publish.py", "def publish(a): gather(a)", 1, g("x.gather")), (2, "r", "gather", "gather(a)", "bus/other.py", "def gather(a): pass", 9, g()),
        (3, "r", "plain", None, "bus/plain.py", "nothing of it", 1, g("publish")), (4, "r", None, None, "a.py", None, None, None), (5, "q", "gather", None, "b.py", "", 1, g()),
    ]
    return spark.createDataFrame(rows, CHUNK)


def test_graph_rank(spark):
    df = chunks(spark)
    assert {tuple(r) for r in C.links_of(df).collect()} == {(1, 2), (3, 1)}
    seeds = {r["doc"]: r["score"] for r in C.anchors(df, C.links_of(df), "publish now").collect()}
    assert seeds[1] == 6 + 2.5 + 1.8 + 1.4 + 0.25 * 0.25 * 2 and set(seeds) == {1, 2, 3}
    got = {r["doc"]: r["score"] for r in C.graph_rank(df, "publish now").collect()}
    assert max(got, key=got.get) == 1 and set(got) == {1, 2, 3}
    assert C.graph_rank(df, "a of the").count() == 0 and C.graph_rank(df.limit(0), "publish").count() == 0


def test_ranks_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id AS doc", "CAST(id % 7 AS DOUBLE) AS score").repartition(9)
    got = sorted((r["rank"], r["doc"]) for r in C.ranked(df).collect())
    assert [r for r, _ in got] == list(range(1, 1001)) and [d for _, d in got] == sorted(range(1000), key=lambda d: (-(d % 7), d))


def test_top_up(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "doc long, score double")
    a, b = table((1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0)), table((2, 5.0), (5, 4.0), (6, 3.0))
    got = [(r["position"], r["doc"], r["filled"]) for r in C.fused_with_top_up({"bm25": a, "graph": b}, 5, each=1).collect()]
    assert got == [(1, 2, False), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)]


def test_candidates(spark):
    rows = [(f"src/m{i:03d}.py", "x retry y" if i % 2 else "Retry") for i in range(50)] + [("node_modules/a.py", "retry"), ("n.txt", "retry"), ("src/deep/er/z_queue.go", None), (None, "retry")]
    df = spark.createDataFrame(rows, "path string, text string")
    assert C.candidate_files(df, "retry it now", globs=["src/**/*queue.go"], limit=3)[:3] == ["src/deep/er/z_queue.go", "src/m001.py", "src/m003.py"]
    assert len(C.candidate_files(df, "retry it now", limit=3)) == 9 and C.candidate_files(df, "of the", limit=3) == []
    assert C.candidate_files(df, "Retry", limit=3, terms=["zzz"])[:1] == ["src/m000.py"]
    scored = [tuple(r) for r in C.file_score(df, ["src/m001.py", "src/m000.py", "src/deep/er/z_queue.go"], "retry queue", globs=["src/deep/**"]).collect()]
    assert scored == [("src/deep/er/z_queue.go", 38), ("src/m001.py", 5), ("src/m000.py", 5)]
    hits = C.context_hits(df, "retry it now", limit=2).orderBy("rank").collect()
    assert [(h["path"], h["line"], h["score"]) for h in hits] == [("src/m001.py", 1, 1.0), ("src/m003.py", 1, 0.9)]
    assert C.context_hits(df.limit(0), "retry").count() == 0
