"""Shorteners on written cases."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import shorten as S


def test_diff_context():
    text = "--- a\n+++ b\n@@ -1 +1 @@\n" + "\n".join(f" l{i}" for i in range(10)) + "\n-x\n+y\n" + "\n".join(f" m{i}" for i in range(6))
    assert S.diff_context(text) == "--- a\n+++ b\n@@ -1 +1 @@\n... [7 more lines]\n l7\n l8\n l9\n-x\n+y\n m0\n m1\n m2\n... [3 more lines]"
    assert S.diff_context("no change\nhere") == "no change\nhere"


def test_patch_hunks():
    one = "diff --git a b\n--- a\n+++ b\n" + "".join(f"@@ {i} @@\n+{i}\n" for i in range(5))
    two = "diff --git c d\n--- c\n+++ d\n@@ 0 @@\n+z"
    assert S.patch_hunks(one + two).split("\n").count("... [2 more hunks]") == 1 and S.patch_hunks(two) == two
    assert "@@ 3 @@" not in S.patch_hunks(one) and "@@ 2 @@" in S.patch_hunks(one)


def test_history_and_status():
    log = "".join(f"commit {i:040x}\nAuthor: A\n\n    Subject {i}\n\n    Body {i} {'w' * 99}\n\n" for i in range(12))
    rows = S.history(log).split("\n")
    assert len(rows) == 11 and rows[1].startswith("00000000 Subject 1 | Body 1 w") and len(rows[1]) == len("00000000 Subject 1 | ") + 60
    assert S.work_tree("M  a\n M b\nMM c\n?? d e\nx") == "staged (2): a, c\nmodified (2): b, c\nuntracked (1): d e"


def test_steps_errors_and_blocks():
    assert S.steps("go\n" + "".join(f"{i}. do\n" for i in range(1, 9))) == "go\n1. do\n2. do\n3. do\n... [3 more steps]\n7. do\n8. do\n"
    trace = "before\nTraceback (most recent call last):\n" + "".join(f'  File "{i}"\n' for i in range(12)) + "ValueError: x\nafter"
    assert S.error_report(trace).split("\n")[6] == "... [5 more lines]" and S.error_report(trace).endswith("ValueError: x\nafter")
    block = "a = [\n" + "\n".join(f"  {i}," for i in range(20)) + "\n]\nb"
    assert S.long_blocks(block).split("\n")[8] == "... [11 more lines]" and S.long_blocks(block).endswith("  19,\n]\nb")


def test_groups():
    lint = "\n".join(f"a.py:{i}:1: E501 long" for i in range(5)) + "\nb.py:1: W1 x\nsummary"
    assert S.by_rule(lint).split("\n") == ["b.py:1: W1 x", "summary", "E501 (5):", "  a.py:0:1: E501 long", "  a.py:1:1: E501 long", "  a.py:2:1: E501 long", "  +2 more"]
    assert S.sections("A:\n  1\n  2\n  3\nB:\n  4\nc", 2) == "A:\n  1\n  2\n... [1 more lines]\nB:\n  4\nc"
    assert S.sixty_forty("a" * 10, 10) == "a" * 10 and S.sixty_forty("a" * 60 + "b" * 60, 10) == "aaaaaa\n... [110 more characters]\nbbbb"


@pytest.mark.parametrize("name", list(S.SHORTENERS))
def test_odd_values(spark, name):
    df = spark.createDataFrame([(None,), ("",), ("plain",), ("x" * 100_000,), ("a\r\nb\n" * 20_000,)], "t string")
    got = [r[0] for r in df.select(S.shortened(name)(F.col("t"))).collect()]
    assert got[0] is None and got[1] == "" and got[2] == "plain" and all(g is not None for g in got[3:])


def test_register():
    S.register("upper", str.upper)
    assert S.SHORTENERS.pop("upper")("a") == "A"
    with pytest.raises(ValueError):
        S.register("steps", str.upper)


def test_passing_tests_become_a_marker():
    log = "start\ntests/a.py::test_x PASSED [ 10%]\ntests/a.py::test_y PASSED\ntests/a.py::test_z FAILED [ 30%]\ntest_a (m.C) ... ok\ntest_b (m.C)\nsays what ... ok\ntest_c (m.C) ... ERROR\ntest_d ... ok"
    assert S.test_runs(log).split("\n") == ["start", "... [2 passing tests]", "tests/a.py::test_z FAILED [ 30%]", "... [2 passing tests]", "test_c (m.C) ... ERROR", "... [1 passing tests]"]
    assert S.test_runs("none of it\n") == "none of it\n"


def test_python_outlines():
    source = 'import os\nX = 1\n\nclass A(B):\n    """of A"""\n\n    @d\n    async def f(self, a=1):\n        """of f"""\n        def g(): pass\n        return g\n\ndef h():\n    return 1\n'
    assert S.python_outline(source) == 'import os\nX = 1\n\nclass A(B):\n    """of A"""\n\n    @d\n    async def f(self, a=1):\n        """of f"""\n        ...\n\ndef h():\n    ...'
    piece = "    return a\n  def f(self):\n" + "      work()\n" * 20 + "LIMIT: int = 3\n"
    assert S.python_outline(piece).split("\n") == ["    # ... [1 more lines]", "  def f(self):", "    # ... [20 more lines]", "LIMIT: int = 3"]
    assert S.python_outline("no python at all (") == "no python at all ("


@pytest.mark.parametrize("name", list(S.COLUMNS))
def test_columns_equal_functions(spark, name):
    texts = ["", "plain", "x" * 3000, "y" * 3001, "é中" * 4000 + "\nshort\n" + "z" * 201, "a\r\n" * 2000, "\n\n"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r[0] for r in df.select(S.COLUMNS[name](F.col("t"))).collect()] == [*map(S.SHORTENERS[name], texts), None]


def test_lengths_share_one_python_step(spark):
    texts = ["", "plain", "é中" * 4000 + "\nshort\n" + "z" * 201, "a\r\n" * 2000, "test_a ... ok\ntest_b ... ok\n", "def f():\n    return 1\n" * 30, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.lengths(F.col("t")).alias("l")).select("l.*")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {t for _, t in df.dtypes} == {"int"} and set(df.columns) | set(S.COLUMNS) == set(S.SHORTENERS)
    assert [r.asDict() for r in df.collect()] == [{n: t if t is None else len(S.SHORTENERS[n](t)) for n in df.columns} for t in texts]


def test_shortened_reads_texts_once_in_python(spark, tmp_path):
    from millrace.plans.memory import shortened

    spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = shortened(spark, str(tmp_path))
    assert df.columns == ["doc_id", *S.SHORTENERS] and {t for _, t in df.dtypes[1:]} == {"int"}
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, df.collect())) == [(1, *[len(f("a\nb")) for f in S.SHORTENERS.values()]), (2, *[None] * len(S.SHORTENERS))]


@pytest.mark.parametrize("name", list(S.SHORTENERS))
@pytest.mark.parametrize("text", ["\n" * 100_000, "test_a\n" + " " * 100_000, "a.py::" * 16_000, "A: " + " " * 5_000, "test_" + "(" * 100_000 + " x ... ok"], ids=["blank", "described", "paths", "typed", "open"])
def test_long_texts_take_time_in_proportion(name, text):
    began = time.thread_time()
    S.SHORTENERS[name](text)
    assert time.thread_time() - began < 2


def test_blank_lines_are_no_steps():
    text = "go\n" + "".join(f"{i}. do\n\n" for i in range(1, 9))
    assert S.steps(text) == "go\n1. do\n\n2. do\n\n3. do\n\n... [3 more steps]\n7. do\n\n8. do\n\n"


@pytest.mark.parametrize("text", ["1+" * 1500 + "1", "a" + ".b" * 1200, "x = 0x" + "9" * 5000])
def test_python_that_can_not_be_written_again(text):
    assert S.python_outline("def f():\n    pass\n" + text) == "def f():\n    # ... [2 more lines]"


def test_passing_tests_with_places():
    passing = ["a.py::b XPASS [ 5%]", "test_a(b c) ... ok", "test_a(b)(c) ...OK \t", "test_a (m.C)\nsays ... what ... ok", "test_a...ok"]
    assert S.test_runs("\n".join(passing)) == "... [5 passing tests]"
    for other in ("a.py:: PASSED", ".py::b PASSED", "test_a () ... ok", "test_ (a) ... ok", "test_a (b) c ... ok", "test_a (m.C) \nsays ... ok", " test_a ... ok", "test_a\ntest_b ... no"):
        assert S.test_runs(other) == other


def test_what_is_searched_for_may_stand_anywhere():
    rest = "\n" + "\n".join(f" l{i}" for i in range(6))
    assert S.diff_context("+a" + rest).endswith("... [3 more lines]") and S.diff_context(rest[1:] + "\n-a").startswith("... [3 more lines]")
    assert S.long_blocks("a (\n" + "  1,\n" * 13 + ")").count("\n") == 14 and S.long_blocks("a (\n" + "  1,\n" * 14 + ")").count("\n") == 11
    assert S.sections("A: \t\n" + " 1\n" * 6 + " 1").endswith("... [2 more lines]") and S.work_tree("x\nR  a\r\n?? b") == "staged (1): a\r\nuntracked (1): b"
    assert S.by_rule("x\na.py:1 W605 y") == "x\nW605 (1):\n  a.py:1 W605 y" and S.history("x\ncommit 0123abc\n\n    S") == "0123abc S"
