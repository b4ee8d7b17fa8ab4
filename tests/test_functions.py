"""Column functions on odd values, and operators that SQL shows too little of."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.functions import text as T
from millrace.operators import ranking as K
from millrace.operators import relational as J
from millrace.streaming import events as E


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column).first()[0]


def text(spark, f, value):
    return one(spark, f(F.col("t")), t=("string", value))


def test_null_and_empty(spark):
    for value in (None, ""):
        assert text(spark, T.token_estimate, value) == 0
        assert text(spark, T.index_tokens, value) == []
        assert text(spark, T.content_type, value) == "GENERIC"
        assert text(spark, T.intent, value) == "background_supplement"
        assert text(spark, L.runs, value) in (None, "")
        assert text(spark, lambda c: L.head_tail(c, 5, 2), value) in (None, "")


def test_runs(spark):
    assert text(spark, L.runs, "\n\na\n a\na\na\nb\n\n\nc") == "a\n[repeated 4 times]\nb\n\nc"
    assert text(spark, L.runs, "  a\na\nb") == "  a\n  a\nb"


@pytest.mark.parametrize("name,parts", [("getHTTPResponse_code", ["get", "http", "response", "code"]), ("__x__", []), ("aBcDe", ["bc", "de"])])
def test_identifier_parts(spark, name, parts):
    assert text(spark, T.identifier_parts, name) == parts


def test_long_text(spark):
    big = "line of words\n" * 20_000
    assert text(spark, lambda c: F.length(L.head_tail(c, 50)), big) < 1000
    assert text(spark, lambda c: F.length(L.runs(c)), big) < 100


def test_cosine_of_odd_vectors(spark):
    for a, b, want in (([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), (None, [1.0], 0.0)):
        assert one(spark, K.cosine(F.col("a"), F.col("b")), a=("array<float>", a), b=("array<float>", b)) == pytest.approx(want)


def test_fusion_and_gap(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2)], "doc string, rank int")
    fused = {x["doc"]: x["score"] for x in K.reciprocal_rank_fusion({"bm25": r, "graph": r.where("rank = 2")}).collect()}
    assert fused["b"] == pytest.approx((0.17 + 0.33) / 62)
    s = spark.createDataFrame([("g", i, v) for i, v in enumerate([1.0, 0.9, 0.85, 0.4, 0.39])], "g string, i int, score double")
    assert K.score_gap(s, "g", [F.desc("score"), F.asc("i")]).count() == 3


def test_upsert_and_levels(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    assert {tuple(r) for r in J.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, None)}
    nodes = spark.createDataFrame([("ctx://a/b", "x", " ", "z")], "uri string, abstract string, overview string, content string")
    assert {(r["level"], r["record_uri"]) for r in J.levels(nodes).collect()} == {(0, "ctx://a/b"), (2, "ctx://a/b/content.md")}


def test_page_rank_is_bounded(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "a", 0.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([("a", 1.0)], "node string, mass double")
    rank = {r["node"]: r["rank"] for r in K.page_rank(e, s).collect()}
    assert rank["a"] > rank["b"] > rank["c"] > 0 and sum(rank.values()) <= 1.0001


def test_rotation_opens_a_part_for_a_row_past_the_limit(spark):
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate([6, 4, 1, 20, 1])] + [(None, 9, 1)], "channel string, seq long, size long")
    assert {(r["seq"], r["part"]) for r in E.rotate(rows, 10).collect()} == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)}


def test_sessions_leave_the_state(spark, tmp_path):
    rows = [("a", 0), ("a", 200), ("a", 499), ("a", 900), ("b", 10), (None, 5), ("b", None), ("z", 9_000_000)]
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "k string, s long").selectExpr("k", "timestamp_seconds(s) AS t")
    df.repartition(3).write.parquet(path)
    got = {tuple(r) for r in E.heartbeat_sessions(spark, path, key="k", at="t", timeout="5 minutes", delay="1 hour").collect()}
    us = 1_000_000
    assert got == {("a", 0, 799 * us, 3), ("a", 900 * us, 1200 * us, 1), ("b", 10 * us, 310 * us, 1), (None, 5 * us, 305 * us, 1), ("z", 9_000_000 * us, 9_000_300 * us, 1)}
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert E.heartbeat_sessions(spark, str(tmp_path / "none"), key="k", at="t").count() == 0
