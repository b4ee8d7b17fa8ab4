"""Chunking, outlines, planning and path tables on written cases."""

import json
import random

from pyspark.sql import functions as F

from millrace.functions import fixed
from millrace.operators import memory as M
from millrace.sources import chunker


def test_windows_cover_every_line_with_overlap():
    rng = random.Random(1)
    for _ in range(100):
        lines = ["x" * rng.randint(0, 80) for _ in range(rng.randint(1, 120))]
        spans = list(chunker.windows(lines, 1, 400, 60))
        assert spans[0][0] == 1 and spans[-1][1] == len(lines)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b + 1 and d > b
            assert sum(len(x) + 1 for x in lines[c - 1 : b]) <= 60
            assert b == a or sum(len(x) + 1 for x in lines[a - 1 : b]) <= 400


def test_python_definitions():
    source = "import os\nfrom a.b import c\n\n@d\ndef f(x, *, y=1):\n    return os.path.join(x)\n\nasync def g():\n    pass\n\nclass A(B.C):\n    def m(self):\n        f(1)\n"
    found = chunker.cut(source, "a.py")
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in found] == [("f", "function", 4, 6, "f(x, y)"), ("g", "async_function", 8, 9, "g()"), ("A", "type", 11, 13, "A")]
    assert found[0][5] == ["os.path.join"] and found[2][7] == ["B.C"] and found[0][6] == ["a.b.c", "os"]
    assert chunker.cut("def f(:\n", "a.py")[0][1] == "code" and chunker.cut("  ", "a.py") == [] and chunker.cut("x", "b.js")[0][:4] == (None, "code", 1, 1)


def test_chunks_of_odd_rows(spark):
    rows = [(1, "r", "a.py", 1, "def f():\n    pass"), (1, "r", "a.py", 1, "def f():\n    pass"), (2, None, "b.txt", 1, None), (3, "r", None, 1, "x"), (4, "r", "c.js", None, "y" * 9000)]
    df = spark.createDataFrame(rows, "chunk_id long, repo string, file_path string, start_line int, content string")
    got = {(r["file_path"], r["symbol"], len(r["content"])) for r in chunker.chunks(chunker.files(df)).collect()}
    assert got == {("a.py", "f", 17), ("c.js", None, 9000)}
    assert chunker.chunks(chunker.files(df.limit(0))).count() == 0


def test_outline(spark):
    value = {"a": [1, 2, 3], "b": {"c": {"d": {"e": 1}}}, "f": None, "g": {}, "h": []}
    lines = chunker.outline(value)
    assert lines[:3] == ["$.a: array of 3", "$.a[0]: number = 1", "$.a[1]: number = 2"] and "$.b.c.d.e: number = 1" in lines and "$.g: empty object" in lines
    df = spark.createDataFrame([(json.dumps(value),), ("{not json",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(chunker.json_summary()(F.col("t"))).collect()]
    assert got == ["\n".join(lines), "{not json", None, ""]


def test_budget(spark):
    df = spark.createDataFrame([(-5,), (0,), (700,), (1400,), (20_000,), (500_000,)], "t int")
    for r in df.select("t", *[c.alias(n) for n, c in M.allocate(F.col("t")).items()]).collect():
        assert sum(r[n] for n in fixed.BUDGET_TIERS) == max(0, r["t"])
    assert (r["identity"], r["archive"], r["working_set"]) == (5000, 40000, 445000)


def test_paths_and_plans(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/bc/d",), ("a/b",), ("a/b/x/y",), (None,)], "path string")
    assert {tuple(r) for r in M.children_of(p, "a/b/").collect()} == {("c", False), ("x", True)}
    assert [r[0] for r in p.select(M.renamed(F.col("path"), "a/b", "z")).collect()] == ["z/c", "a/bc/d", "z", "z/x/y", None]
    assert [r[0] for r in p.select(M.mount_of(F.col("path"), ["a", "a/b"])).collect()] == ["a/b", "a", "a/b", "a/b", None]
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "q")], "k int, h string")
    old = spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (3, None)], "k int, h string")
    assert {tuple(r) for r in M.plan_writes(new, old, ["k"], "h").collect()} == {(1, "skip"), (2, "merge"), (3, "skip"), (4, "create")}
