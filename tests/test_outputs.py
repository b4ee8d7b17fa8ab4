"""Outputs and prompts on written cases and odd values."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import outputs as O


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,kind", [("3 passed in 1 s", "test"), ("Compiling x v1", "build"), ("12:00 DEBUG start", "log"), ('  {"a": 1}', "json"), ("plain words", "generic"), ("", "generic"), (None, None)]
)
def test_kind(spark, text, kind):
    assert one(spark, O.output_kind, text) == kind


def test_progress_goes_and_errors_stay(spark):
    text = "Collecting a\n  Downloading a-1.whl\nERROR: no match\nSuccessfully installed a\n"
    assert one(spark, O.without_install_progress, text) == "ERROR: no match\nSuccessfully installed a\n... [install progress: 2 lines left out]"
    log = '1.2.3.4 - - [x] "GET /a HTTP/1.1" 200\n1.2.3.4 - - [x] "GET /b HTTP/1.1" 500\nother'
    assert one(spark, O.without_access_log, log) == '1.2.3.4 - - [x] "GET /b HTTP/1.1" 500\nother\n... [access log: 1 lines left out]'
    assert one(spark, O.without_access_log, "nothing of it") == "nothing of it"


def test_modes(spark):
    code = "\n".join(f"# note {i}\nx{i} = {i}" for i in range(200))
    kept = one(spark, lambda c: O.shortened(c, "code"), code).split("\n")
    assert len(kept) == 40 + 1 + 15 and not any(r.startswith("#") for r in kept) and kept[0] == "x0 = 0" and kept[-1] == "x199 = 199"
    r = one(spark, O.adaptive, code)
    assert r["kind"] == "GENERIC" or r["kind"] == "CODE"
    assert 0 < r["ratio"] < 1
    assert one(spark, O.adaptive, None)["kind"] == "GENERIC" and one(spark, O.adaptive, "")["ratio"] == 1.0
    for mode in O.MODES:
        assert one(spark, lambda c: O.shortened(c, mode), None) is None and one(spark, lambda c: O.shortened(c, mode), "a\nb") == "a\nb"


def test_commands(spark):
    assert one(spark, O.command_word, "A=1 /usr/bin/pytest -q") == "pytest" and one(spark, O.command_word, None) is None and one(spark, O.command_word, " ") is None
    rows = [("git diff x", "", ""), ("x", "diff --git a/b", "diff_maybe"), ("x", "no", "diff_maybe"), ("x", "KeyError: 1", "python_maybe"), ("x", "y", "test_runner"), (None, None, None)]
    df = spark.createDataFrame(rows, "c string, o string, e string")
    assert [r[0] for r in df.select(O.command_output(F.col("c"), F.col("o"), F.col("e"))).collect()] == ["diff", "diff", "", "python_error", "test_runner", ""]


def test_prompts(spark):
    assert one(spark, O.prompt_keywords, "Please fix the failed build") == "error,implementation,debugging"
    assert one(spark, O.prompt_keywords, "blue skies over town") == "blue,skies,over" and one(spark, O.prompt_keywords, "a 12 ?") == "general" and one(spark, O.prompt_keywords, None) == ""
    assert one(spark, O.prompt_topic, "fix the parser") == "parser" and one(spark, O.prompt_topic, "add it to module loader") == "loader" and one(spark, O.prompt_topic, "hm") is None


@pytest.mark.parametrize(
    "text,kind,words",
    [
        ("--- a/y.py\n+++ b/x.py\n@@", "patch", "patch,x.py,y.py"), ('{"name": "grep", "arguments": 1}', "tool_call", "tool_call,grep"),
        ("Traceback (most recent call last)\nError: no such thing", "error", "error,Error,no such thing"), ("x\n" * 300 + "", "generic", "generic"),
        ("1. Read the log\n2. Find it\n" + "so on and on\n" * 60, "reasoning", "reasoning,Read the log,Find it,so on and on"),
        ("import os\nif x:\n# note\n@dec\ndef f():\n", "code", "code,decorator:dec,def:f"), ("The HTTP server of the CPU\nfine", "generic", "generic,The HTTP server the,HTTP"), ("", "generic", "generic"), (None, "generic", "generic"),
    ],
)
def test_replies(spark, text, kind, words):
    from millrace.functions import replies as P

    assert one(spark, P.reply_kind, text) == kind and one(spark, P.reply_words, text) == words


def test_usage(spark):
    from millrace.functions import fixed
    from millrace.operators import usage as U

    calls = spark.createDataFrame([("s", "read", "success", 5, 1), ("s", "read", None, None, None), ("s", "write", "completed", 2, 3), ("s", "", "success", 9, 9), (None, "read", "x", 1, 1)], "session string, tool string, status string, ms long, tokens long")
    stats = {(r["session"], r["tool"]): (r["calls"], r["good"], r["bad"], r["ms"], r["tokens"]) for r in U.tool_stats(calls).collect()}
    assert stats == {("s", "read"): (2, 1, 1, 5, 1), ("s", "write"): (1, 1, 0, 2, 3), (None, "read"): (1, 0, 1, 1, 1)}
    assert U.tool_report(U.tool_stats(calls)).where("session = 's'").first()["report"] == "- read: 2 calls, 1 good, 1 bad\n- write: 1 calls, 1 good, 0 bad"
    texts = spark.createDataFrame([(1, 'File "a.py", line 3\nFile "b.py", line 4\nfine'), (2, '  File "a.py", line 9'), (3, None), (4, "")], "doc_id int, text string")
    assert [(r["lines"], r["texts"], r["example"]) for r in U.line_templates(texts, fixed.ERROR_LINE).collect()] == [(3, 2, 'File "a.py", line 3')]
    tree = spark.createDataFrame([("a/b/c", 2), ("a/d", 3), ("e", None), (None, 9)], "path string, n int")
    assert {tuple(r) for r in U.rolled_up(tree, {"n": F.col("n")}).collect()} == {("", 3, 5), ("a", 2, 5), ("a/b", 1, 2)}


def test_routing(spark):
    profiles = (O.Profile("a", "x", commands=("git",)), O.Profile("b", "y", patterns=("zz",), priority=3), O.Profile("c", "z", patterns=("zz",), priority=3), O.Profile("d", "w", extensions=("py",)))
    rows = [("zz", "git log", None, None), ("zz", None, "a.py", None), ("q", None, "a.PY", "k"), ("q", "ls", "a.c", "k"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, c string, p string, k string")
    got = [r[0] and (r[0]["name"], r[0]["score"]) for r in df.select(O.routed(F.col("t"), F.col("c"), F.col("p"), F.col("k"), profiles)).collect()]
    assert got == [("a", 100), ("b", 50), ("d", 30), None, None]
