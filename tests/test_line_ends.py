"""Queries by lines take every row whatever its line ends, and so does their SQL."""

from pathlib import Path

import duckdb
import pytest

from millrace.plans import queries as core

DATA = Path("/root/testdata/sf0.001")
QUERIES, SQL = core.queries(), core.oracle_sql()
NORMAL = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"
LOG = [f"step {i} of the run" for i in range(30)] + ["ERROR lost: x", "WARNING: a 1.2 /tmp/a", "WARNING: a 1.3 /tmp/b", "INFO fine", "same", " same", "same", "same", "", "", "end"]


def rows(found):
    return sorted(tuple(map(str, r)) for r in found)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["comment_filter", "signature_filter"])
def test_code_with_any_line_end(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW code_chunk AS SELECT * REPLACE ({NORMAL.format('content')} AS content) FROM read_parquet('{DATA}/code_chunk.parquet')")
    df = QUERIES[name](spark, str(DATA))
    got = df.collect()
    assert rows(got) == rows(db.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())
    assert len(got) == db.execute("SELECT count(*) FROM code_chunk").fetchone()[0]


@pytest.mark.parametrize("name", ["head_tail", "critical_first", "line_summary", "line_runs", "distinct_warnings", "noise_drop"])
def test_documents_with_any_line_end(spark, tmp_path, name):
    texts = [(1, "\n".join(LOG)), (2, "\r\n".join(LOG) + "\r\n"), (3, "\r".join(LOG[::-1])), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * REPLACE ({NORMAL.format('text')} AS text) FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES[name](spark, str(tmp_path)).select("doc_id", "digest").collect()
    assert rows(got) == rows(db.execute(f"SELECT doc_id, digest FROM ({SQL[name]})").fetchall())
    assert [r["digest"] for r in got if r["doc_id"] == 4] == [None]


@pytest.mark.parametrize("name", ["head_tail", "critical_first", "line_summary", "line_runs", "distinct_warnings", "noise_drop", "line_kinds"])
def test_sql_takes_any_line_end_itself(spark, tmp_path, name):
    texts = [(1, "\n".join(LOG)), (2, "\r\n".join(LOG) + "\r\n"), (3, "\r".join(LOG[::-1])), (4, "a\x0b\n\x85b c")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    assert rows(df.collect()) == rows(db.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())


def test_code_paths(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text as T

    paths = {
        "a/b.py": True, "a\\b.HPP": True, "x.h": True, "/a.py": False, "a/../b.py": False, "a/.cache-1/b.py": False, ".cache/b.py": False, "env/b.py": False, ".turbo/b.py": False,
        "target/b.rs": True, "vendor/b.go": True, "a/.py": False, "a.txt": False, "": False, "a/env.py": True, None: False,
    }
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["c"] for r in df.select("p", T.is_code_path(F.col("p")).alias("c")).collect()} == paths
