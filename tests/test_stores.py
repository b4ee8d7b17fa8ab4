"""Stores, access and assembly on written cases and odd rows."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import assembly as A
from millrace.operators import relational as J
from millrace.sources import stores as S


def test_code_files(spark, tmp_path):
    for p, text in {"a/x.py": "é = 1\n", "a/node_modules/y.js": "b", "z.H": "c", "a/n.txt": "d", "z.h": "int a;"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text, encoding="utf-8")
    got = {r["path"]: (r["size"], r["text"]) for r in S.code_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": (7, "é = 1\n"), "z.h": (6, "int a;")}


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"a": 1, "b": "x"}', [(1, "x")]), ('[{"a": 1}, {"b": "y"}]', [(1, None), (None, "y")]), ('{"a": 1}\n\nno json\n{"a": 2, "c": 3}\n', [(1, None), (2, None)]),
        ('{\n "a": 5\n}', [(5, None)]), ("", []), ("no json", []), (None, []), ("[]", []),
    ],
)
def test_json_rows(spark, text, want):
    got = S.json_rows(spark.createDataFrame([(text,)], "t string"), "t", "a int, b string").collect()
    assert [tuple(r) for r in got] == want


def test_logs_and_rows(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": "a"}\nbroken{\n{"k": 2}\n')
    rows = S.event_log(spark, str(tmp_path / "log.jsonl"), "k int, v string")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "a"), (2, None)]
    S.write_rows(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["k"] for x in lines) == [1, 2] and all("v" in x for x in lines)
    assert S.row_by_key(rows, "k").first()["k"] == 1 and S.row_by_key(rows, "k", 2).first()["k"] == 2 and S.row_by_key(rows, "k", 9).count() == 0
    rows.createOrReplaceTempView("some_log")
    assert ("some_log", True) in {(r["name"], r["temporary"]) for r in S.catalog(spark).collect()}
    assert [tuple(r) for r in S.table_facts(rows).orderBy("position").collect()] == [(0, "k", "int", 2), (1, "v", "string", 2)]


def test_keys_trees_and_nodes(spark):
    kv = spark.createDataFrame([("a/b", bytearray(b"xy")), ("c", None)], "key string, value binary")
    assert {tuple(r) for r in S.key_listing(kv).collect()} == {("b", 2), ("c", None)}
    assert {r["key"] for r in S.with_renamed_key(kv, "a/b", "d").collect()} == {"c", "d"}
    for old, new in (("zz", "d"), ("a/b", "c")):
        with pytest.raises(KeyError):
            S.with_renamed_key(kv, old, new)
    p = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a_c/d",)], "path string")
    assert {r[0] for r in S.without_tree(p, "a/").collect()} == {"ab", "a_c/d"} and S.without_tree(p, "/").count() == 0
    files = [("n/1/content.md", "c"), ("n/1/.meta.json", '{"status": "ACTIVE"}'), ("n/2/content.md", "c"), ("n/2/.meta.json", '{"status": "BROKEN"}'), ("n/3/content.md", "c"), (None, "x")]
    assert [tuple(r) for r in S.nodes_of(spark.createDataFrame(files, "path string, text string")).collect()] == [("n/1", "c", None, None, "ACTIVE")]


def test_archives_and_events(spark, tmp_path):
    kind = "archive_id string, session_id string, overview string, messages array<string>"
    for i in range(2):
        S.write_archive(spark, str(tmp_path / "a"), {"archive_id": None, "session_id": "s", "overview": f"o{i}", "messages": ["m"]}, kind)
    got = S.archives(spark.read.parquet(str(tmp_path / "a")), "s").collect()
    assert len(got) == 2 and "messages" not in got[0].asDict() and got[0]["archive_id"] >= got[1]["archive_id"]
    e = spark.createDataFrame([(1, "pending ", 5), (2, "PENDING", None), (3, "DONE", 1), (4, "PENDING", 9)], "id int, status string, next_retry_at long")
    assert {r["id"] for r in S.due(e, F.lit(6)).collect()} == {1, 2}
    payload = json.dumps({"records": [{"id": "a", "uri": "u", "level": 0}, {"id": None, "uri": "u"}]})
    rows = spark.createDataFrame([("e1", payload), ("e2", "broken"), ("e3", None)], "event_id string, payload string")
    assert [tuple(r) for r in S.records_of(rows, "id string, uri string, level int", ("id", "uri")).collect()] == [("e1", "a", "u", 0)]


def test_plans_and_access(spark):
    s = A.Scope("a", "u", "g", ("agent:g", "agent:h", "user:u"))
    assert A.root_uris("memory", s) == ["ctx://a/users/u/memories/", "ctx://a/agents/g/memories/", "ctx://a/agents/h/memories/"] and len(A.root_uris(None, s)) == 6 and A.root_uris("x", s) == []
    assert A.owner_spaces("SKILL", A.Scope("a", "u", "k", ("agent:h",))) == ["agent:h"] and A.owner_spaces("SKILL", A.Scope("a", "u", "", ("user:u",))) == [A.NOWHERE] and A.owner_spaces("MEMORY", A.Scope("a")) is None
    p = A.plan("```x```how to decide", s, top_k=7)
    assert (p["text"], p["kind"], p["intent"], p["top_k"], p["owner_spaces"]) == ("how to decide", "SKILL", "reusable_skills", 7, ["agent:g"])
    for text, n in (("  ", 0), ("x", 51)):
        with pytest.raises(ValueError):
            A.plan(text, s, top_k=n)
    uris = {"ctx://a/users/u/m": (True, True), "ctx://a/users/v/m": (False, False), "ctx://a/agents/g": (True, False), "ctx://b/resources/x": (False, False), "ctx://a/resources/x": (True, True), "file": (False, True), None: (False, False)}
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    assert {r["u"]: (r["x"], r["y"]) for r in df.select("u", A.accessible(F.col("u"), s).alias("x"), A.readable(F.col("u"), s).alias("y")).collect()} == uris


def test_answers(spark):
    kind = "uri string, level int, score double, category string, owner_space string, abstract string, rank int"
    hits = spark.createDataFrame([("a", 2, 0.5, "c", "o", "x", 1), ("a", 2, 0.9, "d", "o", "y", 2), ("b", 2, 0.9, None, "o", None, 3), ("f", 1, 1.0, "c", "o", "z", 4)], kind)
    contents = spark.createDataFrame([("a", "text"), ("a", "text"), ("b", "other")], "uri string, content string")
    edges = spark.createDataFrame([("a", f"t{i}", "r", float(i)) for i in range(5)], "from_uri string, to_uri string, relation_type string, weight double")
    got = A.assembled(hits, 5, contents=contents, filled=1, edges=edges).orderBy("position").collect()
    assert [(r["uri"], r["score"], r["category"], r["content"], r["relations"]) for r in got] == [("a", 0.9, "d", "text", ["t4", "t3", "t2"]), ("b", 0.9, None, None, [])]
    assert A.assembled(hits.limit(0), 5).count() == 0
    assert {(r["uri"], r["query"]) for r in A.first_seen([hits.where("rank > 2"), hits]).collect()} == {("b", 0), ("f", 0), ("a", 1)}
    named = spark.createDataFrame([("ctx://a/src_m_py-1",), ("ctx://a/other",)], "uri string")
    assert A.of_candidates(named, ["src/m.py"]).count() == 1 and A.of_candidates(named, []).count() == 2
    assert J.without_ids(hits, spark.createDataFrame([("a",), (None,)], "uri string"), "uri").count() == 2
