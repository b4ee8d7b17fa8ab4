"""Names, addresses and small texts on written cases and odd values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.streaming import queues as Q


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "uri,folder",
    [
        ("ctx://a/users/u/memories/profile", "/accounts/a/users/u/memories/profile/"), ("ctx://a/agents/g/memories/case/x%20y", "/accounts/a/agents/g/memories/case/x y/"), ("ctx://a/agents/g/skills/s", "/accounts/a/agents/g/skills/s/"),
        ("ctx://a/users/u/memories/", "/accounts/a/users/u/memories/"), ("ctx://a/sessions/s/history/h", "/accounts/a/sessions/s/history/h/"), ("ctx://a/users/u/skills/s", None), ("file", None), (None, None),
    ],
)
def test_folder(spark, uri, folder):
    assert one(spark, N.folder_of(F.col("u")), u=("string", uri)) == folder


def test_slugs_and_questions(spark):
    c = F.col
    slug = lambda *v: one(spark, N.code_slug(c("l"), c("p"), c("s"), c("a"), c("b")), l=("string", v[0]), p=("string", v[1]), s=("string", v[2]), a=("int", v[3]), b=("int", v[4]))
    assert slug("py", "a/b.c.py", "F.g", 1, 9) == "py_b_c_f_g_1_9_" + hashlib.sha1(b"py:a/b.c.py:F.g:1-9").hexdigest()[:16]
    assert slug(None, None, None, None, None) == "unknown_file_symbol_0_0_" + hashlib.sha1(b"unknown::symbol:0-0").hexdigest()[:16] and len(slug("py", "a.py", "x" * 200, 1, 2)) == 96 + 17
    ask = lambda p, i: one(spark, N.path_question(c("p"), c("i")), p=("string", p), i=("string", i))
    assert ask("src/a.py", None) == "a.py src/a.py src_a_py a_py a" and ask("src/a.py", "why a_py") == "why a_py src_a_py a" and ask(None, " x ") == "x"
    assert one(spark, N.scoped_question(c("q"), c("h")), q=("string", " find it "), h=("array<string>", ["getUser", "src/**/user_db.py"])) == "find it\nscope: get user src db py"
    assert one(spark, N.scoped_question(c("q"), c("h")), q=("string", None), h=("array<string>", [])) == ""


def test_small_ones(spark):
    s = lambda f, v, t="string": one(spark, f(F.col("x")), x=(t, v))
    assert s(N.hints, "a, b\nb,,c ") == ["a", "b", "c"] and s(N.hints, None) == [] and s(lambda x: N.newest(x, 3), "abcde") == "cde" and s(lambda x: N.newest(x, 3), None) == ""
    assert [s(lambda x: N.inside(x, ["/new/", "/old"]), v) for v in ("/new/a/b", "/old/c", "/newer/a", "/new")] == ["a/b", "c", "", "."]
    assert [s(N.looks_like_path, v) for v in ("a/b", "a.py", "word", "", None)] == [True, True, False, False, False]
    assert s(lambda x: N.some_lines(x, F.lit(2), F.lit(9)), "a\nb\nc") == "b\nc" and s(lambda x: N.some_lines(x, F.lit(3), F.lit(1)), "a\nb\nc") == ""
    assert s(N.vector_literal, [0.5, -1.0, 0.126953125], "array<float>") == "[0.50000000,-1.00000000,0.12695312]" and s(N.vector_literal, None, "array<float>") is None
    assert one(spark, N.flat({"a": F.col("a"), "b": F.col("b")}), a=("int", 1), b=("string", None)) == {"a": "1"}
    for rows, part, at in ((["a", "b", "a", "b", "c"], ["a", "b"], 2), (["a"], ["a", "b"], -1), (["a"], [], -1), ([], ["a"], -1), (["x", "a"], ["a"], 1)):
        assert one(spark, N.last_occurrence(F.col("r"), F.col("p")), r=("array<string>", rows), p=("array<string>", part)) == at
    name = N.part_name("{channel}-{datetime}-{index}.log", F.col("c"), F.lit("2025-03-04 05:06:07").cast("timestamp"), F.col("i"))
    assert one(spark, name, c=("string", "c"), i=("int", 7)) == "c-20250304_050607-000007.log"


def test_seeded_vector(spark):
    for text in ("a", "", "中文"):
        x, want = int(hashlib.md5(text.encode()).hexdigest(), 16), []
        for _ in range(5):
            x = (1103515245 * x + 12345) & 0x7FFFFFFF
            want.append(x / 0x7FFFFFFF * 2 - 1)
        assert one(spark, N.seeded_vector(F.col("t"), 5), t=("string", text)) == pytest.approx(want)


def test_readers_and_queues(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 5), ("b", None), (None, 1)], "stream string, seq long").repartition(7)
    got = {}
    for r in Q.retained(rows, "stream", "seq", 100).collect():
        got.setdefault(r["stream"], set()).add(r["seq"])
    assert got == {"a": set(range(200, 300)), "b": {5}, None: {1}}
    m = spark.createDataFrame([(i, "q", f"m{i}") for i in range(5)], "id long, queue_name string, message_id string")
    Q.enqueue(m, str(tmp_path / "q"))
    first, rest = Q.taken(spark.read.parquet(str(tmp_path / "q")), 2)
    assert {r["id"] for r in first.collect()} == {0, 1} and {r["id"] for r in rest.collect()} == {2, 3, 4}
