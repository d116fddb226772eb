"""Stored tables changed by key: versions, writers that meet, broken ones, numbers drawn by many."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillflow.sources import tables

SCHEMA = "job_id string, status string, progress int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA).coalesce(1)


def content(spark, path, version=None):
    return sorted((tuple(r) for r in tables.read(spark, path, "job_id", version).collect()), key=str)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "jobs")
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path, "job_id")
    assert tables.change(rows(spark, ("a", "pending", 0), ("b", "pending", 0), (None, "x", 1), ("a", "pending", 5)), path) == 1
    assert tables.change(rows(spark, ("a", "done", 100), ("c", "pending", None)), path) == 2
    assert tables.change(rows(spark, ("b", None, None)), path, deleted=True) == 3
    second = [("a", "done", 100), ("b", "pending", 0), ("c", "pending", None), (None, "x", 1)]
    assert content(spark, path, 1) == sorted([("a", "pending", 5), ("b", "pending", 0), (None, "x", 1)], key=str)
    assert content(spark, path, 2) == sorted(second, key=str)
    third = sorted([second[0], second[2], second[3]], key=str)
    assert content(spark, path) == third
    assert tables.compact(spark, path, "job_id") == 3 and tables.compact(spark, path, "job_id") == 3
    assert content(spark, path) == third and content(spark, path, 2) == sorted(second, key=str)
    assert tables.change(rows(spark, ("b", "again", 1), (None, "y", 2)), path) == 4
    assert content(spark, path) == sorted([second[0], ("b", "again", 1), second[2], (None, "y", 2)], key=str)
    assert tables.change(rows(spark).limit(0), path) == 5 and len(content(spark, path)) == 4


def test_broken_writers(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.change(rows(spark, ("a", "pending", 0)), path)
    rows(spark, ("a", "broken", 9)).withColumn("deleted", F.lit(False)).write.parquet(f"{path}/_temporary-lost")
    assert content(spark, path) == [("a", "pending", 0)]
    with pytest.raises(tables.Conflict):
        tables.change(rows(spark, ("a", "late", 1)), path, expect=0)
    assert content(spark, path) == [("a", "pending", 0)] and tables.latest(spark, path) == 1
    assert [f.name for f in (tmp_path / "jobs").iterdir() if f.name.startswith("_temporary")] == ["_temporary-lost"]


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.change(rows(spark, *[(f"j{i}", "pending", 0) for i in range(8)]), path)

    def status(i):
        return tables.update(rows(spark, (f"j{i}", f"s{i}", None), ("none", "x", 1)), path, "job_id")

    def progress(i):
        return tables.update(rows(spark, (f"j{i}", None, i)).select("job_id", "progress"), path, "job_id")

    with ThreadPoolExecutor(6) as pool:
        work = [pool.submit(f, i) for i in range(4) for f in (status, progress)]
        work.append(pool.submit(tables.compact, spark, path, "job_id"))
        versions = [w.result() for w in work[:-1]]
    assert sorted(versions) == list(range(2, 10))
    want = [(f"j{i}", f"s{i}" if i < 4 else "pending", i if i < 4 else 0) for i in range(8)]
    assert content(spark, path) == want


def test_numbers_of_several_jobs(spark, tmp_path):
    path = str(tmp_path / "numbers")
    old = spark.createDataFrame([(5,), (None,)], "numero_doc int")

    def job(k):
        new = spark.range(10 + k).select(F.col("id").alias("k"), F.lit(k).alias("job"))
        return [(r["k"], r["numero_doc"]) for r in tables.numbered(new, old, ["k"], path).orderBy("k").collect()]

    with ThreadPoolExecutor(4) as pool:
        drawn = list(pool.map(job, range(4)))
    for k, found in enumerate(drawn):  # each job's own are in order and without gaps
        assert [n for _, n in found] == list(range(found[0][1], found[0][1] + 10 + k))
    numbers = [n for found in drawn for _, n in found]
    assert sorted(numbers) == list(range(6, 6 + len(numbers)))
    assert tables.reserve(spark, path, 7) == 6 + len(numbers)  # a job that breaks off leaves a gap
    assert job(0)[0][1] == 13 + len(numbers)
    assert tables.numbered(spark.range(0).select(F.col("id").alias("k")), old, ["k"], path).count() == 0
    assert tables.reserve(spark, path, 1, least=1000) == 1000 and tables.reserve(spark, path, 1) == 1001
