"""Hierarchical search on a small tree."""

from millrace.operators import search


def test_tree(spark):
    rows = [
        ("r", "ctx://a/r", 0, None, [1.0, 0.0]), ("d", "ctx://a/r/d", 1, "ctx://a/r/", [0.6, 0.8]), ("l1", "ctx://a/r/d/content.md", 2, "ctx://a/r/d", [1.0, 0.0]),
        ("l2", "ctx://a/r/x/content.md", 2, "ctx://a/r", [0.0, 1.0]), ("l2", "ctx://a/r/x/content.md", 2, "ctx://a/r", [0.0, 1.0]), ("n", "ctx://a/n", 2, None, None), ("z", "ctx://a/z", 2, "ctx://a/q", [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "id string, uri string, level int, parent_uri string, embedding array<float>")
    got = {r["uri"]: round(r["score"], 4) for r in search.hierarchical(df, [1.0, 0.0], seed=2).collect()}
    assert got == {"ctx://a/r/d": 0.8, "ctx://a/r/d/content.md": 1.0, "ctx://a/r/x/content.md": 0.5}
    assert search.hierarchical(df.limit(0), [1.0, 0.0]).count() == 0
    hits = df.selectExpr("uri", "level", "0.5D AS score")
    leaves, folders = search.starting_points(hits, spark.createDataFrame([("ctx://a/r",), ("ctx://b",)], "uri string"))
    assert leaves.count() == 5 and {tuple(r) for r in folders.collect()} == {("ctx://a/r", 0.5), ("ctx://a/r/d", 0.5), ("ctx://b", 0.0)}
