"""The training-data queries, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import code_origin, leakage, mixing, splitting, syntax, truncation
from millrace.llm import near_duplicates as nd
from millrace.llm import neighbours as nn
from millrace.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = nd.near_duplicates(table(spark, sf_dir, "code_chunk"))
    return nd.similar_pairs(members, links).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = nd.near_duplicates(table(spark, sf_dir, "code_chunk"))
    return nd.groups(members, links).withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_origin.not_hand_written(table(spark, sf_dir, "code_chunk")).where("reason IS NOT NULL").select("repo", "file_path")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_origin.not_hand_written(table(spark, sf_dir, "code_chunk"))
    return files.groupBy("repo", "reason").agg(F.count("*").alias("files"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, sf_dir, "code_chunk"))
    return pieces.where("piece = 1").select("chunk_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "code_chunk"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.parsed_files(table(spark, sf_dir, "code_chunk")).where("broken").select("repo", "file_path")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_rates(table(spark, sf_dir, "code_chunk"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nn.neighbours(table(spark, sf_dir, "index_record"), 5, min_cosine=0.90, degree=16, cuttings=16, rounds=2)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "index_record")
    uris = records.groupBy("id").agg(F.min_by(F.struct("uri", "level"), F.struct("level", "uri")).alias("r")).select("id", "r.uri", "r.level")
    near = nn.neighbours(records, 5, degree=20, cuttings=32, rounds=5)
    return near.join(uris.select(F.col("id").alias("neighbour"), "uri", "level"), "neighbour").select("id", "level", "rank", "neighbour", "uri", "cosine")


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("level"), "embedding")
    members, nodes = nn.prepare(records)
    links = nn.graph(nodes, degree=24, cuttings=4, rounds=nn.ROUNDS)
    asked = members.where("id % 20 = 0").join(nodes, "node").select(F.col("id").alias("qid"), "level", "code")
    found = nn.search(nodes, links, asked, 6)
    return found.join(members, "node").select(F.col("qid").alias("vec_id"), F.col("id").alias("neighbour"), "sim").where("vec_id <> neighbour")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.where(F.col("word_run") >= leakage.PASSAGE).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).where(F.col("word_run") >= leakage.PASSAGE)
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("word_run").alias("longest_run"))


def p7_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that were edited: their alignment covers twelve words, but there is no run of twelve equal ones."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.where((F.col("word_run") < leakage.PASSAGE) & (F.col("words") >= leakage.PASSAGE))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return ORACLES


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

_RUNS = f"""i AS (SELECT DISTINCT item_id, {_WORDS.format("text")} AS w FROM eval_item WHERE text IS NOT NULL), d AS (SELECT DISTINCT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
        ig AS (SELECT DISTINCT item_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
        dg AS (SELECT DISTINCT doc_id, q, array_to_string(w[q:q + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS q FROM d)),
        m AS (SELECT doc_id, item_id, q, q - p AS diagonal FROM dg JOIN ig USING (g)),
        r AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q) AS run FROM m),
        l AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, diagonal, run)"""

ORACLES = {
    "p7_items": f"WITH {_RUNS} SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(n) AS INT) AS longest_run FROM l GROUP BY item_id",
    "p1_found": r"""
        WITH c AS (SELECT chunk_id, any_value(content) AS t FROM code_chunk WHERE chunk_id IS NOT NULL AND content IS NOT NULL GROUP BY 1),
        w AS (SELECT chunk_id, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS w FROM c),
        s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.chunk_id < b.chunk_id GROUP BY ALL)
        SELECT a AS chunk_a, b AS chunk_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p1_groups": r"""
        WITH RECURSIVE c AS (SELECT chunk_id, any_value(content) AS t FROM code_chunk WHERE chunk_id IS NOT NULL AND content IS NOT NULL GROUP BY 1),
        w AS (SELECT chunk_id, regexp_extract_all(t, '[\p{L}\p{N}_]+') AS w FROM c),
        s0 AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w),
        k AS (SELECT chunk_id, md5(string_agg(s, chr(10) ORDER BY s)) AS k, count(*) AS n FROM s0 GROUP BY 1),
        m AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY k) AS rep, n FROM k),
        s AS (SELECT s0.chunk_id, s, n FROM s0 JOIN m ON m.chunk_id = s0.chunk_id AND m.rep = m.chunk_id),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, any_value(a.n) AS x, any_value(b.n) AS y, count(*) AS z FROM s a JOIN s b USING (s) WHERE a.chunk_id <> b.chunk_id GROUP BY ALL),
        e AS (SELECT a, b FROM p WHERE z >= 0.6 * (x + y - z)),
        r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        g AS (SELECT a, min(b) AS g FROM r GROUP BY 1), d AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
        SELECT chunk_id, coalesce(g, rep) AS group_id, coalesce(links, 0) AS links FROM m LEFT JOIN g ON g.a = rep LEFT JOIN d ON d.a = rep""",
    "p3_found": "SELECT DISTINCT chunk_id FROM code_chunk WHERE length(content) > 4000 AND chunk_id IS NOT NULL",
    "p6_found": """
        WITH r AS (SELECT id, any_value(level) AS level, any_value(embedding) AS e FROM index_record WHERE len(embedding) = 64 GROUP BY 1),
        u AS (SELECT id, level, CAST(e AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS n FROM r),
        p AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.e, b.e) / (a.n * b.n) AS s FROM u a JOIN u b ON a.level = b.level AND a.id <> b.id WHERE a.n > 0 AND b.n > 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM p)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM t WHERE k <= 5 AND s >= 0.9""",
    "p7_found": f"""
        WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_item), d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
