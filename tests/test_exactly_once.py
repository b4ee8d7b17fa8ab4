"""One copy of each message, over many batches, with late and odd rows."""

import random
import shutil

import pytest

from millrace.streaming import exactly_once as eo

SCHEMA = "id long, queue_name string, message_id string, timestamp long, status string, queue int, key string, kept string"


def write(spark, rows, path, files=1):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA)
    df.repartition(files).write.mode("overwrite").parquet(path)
    return path


def expected(rows):
    first, repeated = {}, set()
    for r in sorted(rows):
        k = (r[1], (r[2] or "").strip().lower())
        if not k[1]:
            first[r[0]] = r[0]
        elif k in first:
            repeated.add(k)
        else:
            first[k] = r[0]
    return sorted(first.values()), repeated


def test_copies_over_many_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        day = rng.choice([0, 1, 2, 30, 60, 90]) * 86_400
        t = 1_740_000_000 + day + i
        rows.append((i, rng.choice(["a", "b", None]), rng.choice([" M1", "m1\t", "M2", f"m{i % 40}", "", "  ", None]), rng.choice([t, t * 1000, None]), "pending"))
    base, path = str(tmp_path / "state"), str(tmp_path / "in")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for part in (rows[:200], rows[200:400], rows[400:]):  # three runs share one checkpoint; each reads new files only
        spark.createDataFrame([(*r, 7, "x", "y") for r in part], SCHEMA).repartition(2).write.mode("append").parquet(path)
        kept_rows = eo.unique_messages(spark, path, at=base, bytes_per_batch=2000)
    kept, repeated = expected(rows)
    assert sorted(r["id"] for r in kept_rows.collect()) == kept
    got = eo.repeated(spark, path, at=str(tmp_path / "other"), bytes_per_batch=2000)
    assert {tuple(r) for r in got.collect()} == {(q, k) for q, k in repeated}
    entries = spark.read.parquet(f"{base}/ledger")
    assert entries.select("batch").distinct().count() > 3  # many batches, and rows too late for the state
    assert entries.where("kind = 'late' AND rank.arrival IS NOT NULL").count() > 20
    # what the stream has written decides: without one batch of it, messages are missing or other copies stay
    shutil.rmtree(f"{base}/ledger/batch=1")
    damaged = {r["id"] for r in eo.unique_messages(spark, path, at=base, bytes_per_batch=2000).collect()}
    assert set(kept) - damaged and len(damaged) < len(kept)


def test_one_row_stays_of_equal_or_null_orders(spark, tmp_path):
    t = 1_740_000_000
    rows = [(1, "a", "m1", t, "x"), (1, "a", "m1", t, "x"), (1, "a", "m1", t, "y"), (None, "a", "m2", t, "x"), (None, "a", "m2", t, "y"), (None, None, "m3", None, "x"), (None, "a", "m4", t, "x"), (5, "a", "m4", t, "x"), (6, "a", "", t, "x"), (6, "a", "", t, "x")]
    path = write(spark, rows, str(tmp_path / "in"), 3)
    write(spark, [(77, "z", "other", t, "x")], str(tmp_path / "in2"))  # a sibling of the same prefix is not read
    out = eo.unique_messages(spark, path)
    assert out.columns == spark.read.parquet(path).columns
    assert sorted((r["message_id"], r["id"]) for r in out.collect()) == [("", 6), ("", 6), ("m1", 1), ("m2", None), ("m3", None), ("m4", 5)]
    assert {r["message_id"] for r in eo.repeated(spark, path).collect()} == {"m1", "m2", "m4"}


def test_nothing_comes_from_an_empty_ledger(spark, tmp_path):
    t = 1_740_000_000
    path = write(spark, [(i, "a", f"m{i % 3}", t, "x") for i in range(9)], str(tmp_path / "in"))
    base = eo.run_stream(spark, path)
    assert eo.read_ledger(spark, base, path).where("copies = 3").count() == 3
    shutil.rmtree(f"{base}/ledger")
    assert eo.read_ledger(spark, base, path).count() == 0


def test_single_file(spark, tmp_path):
    path = write(spark, [(1, "a", "m", 1_740_000_000, "x"), (2, "a", "M ", None, "x")], str(tmp_path / "in"))
    file = next((tmp_path / "in").glob("*.parquet"))
    file.rename(tmp_path / "one.parquet")
    assert {tuple(r) for r in eo.repeated(spark, str(tmp_path / "one.parquet")).collect()} == {("a", "m")}


def test_empty_table(spark, tmp_path):
    path = write(spark, [], str(tmp_path / "in"))
    assert eo.repeated(spark, path).count() == 0 and eo.unique_messages(spark, path).count() == 0


@pytest.mark.parametrize("value,want", [(" A\t", "a"), ("", None), (None, None), ("  ", None)])
def test_identifier(spark, value, want):
    assert spark.createDataFrame([(value,)], "k string").select(eo.normal_id(eo.F.col("k"))).first()[0] == want
