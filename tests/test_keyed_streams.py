"""Keyed streaming state: jobs with an end, messages with a lease."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quillflow.sources import sinks
from quillflow.streaming import jobs, keyed

SCHEMA = "job_id string, event_time timestamp, status string, progress int, error string, document_id int"
START = datetime.datetime(2024, 1, 1)


def at(s):
    return START + datetime.timedelta(seconds=s)


def job_events(seed=1, n=25):
    rng = random.Random(seed)
    rows = []
    for j in range(n):
        base = rng.randint(0, 600)
        rows.append((f"j{j}", at(base), "pending", None, None, None))
        for k in range(rng.randint(0, 4)):
            rows.append((f"j{j}", at(base + 10 * k + 5), rng.choice(["processing", "analyzing"]), rng.choice([None, 33, 70]), None, None))
        if j % 3 == 0:
            rows.append((f"j{j}", at(base + 60), "completed", None, None, j))
        if j % 3 == 1:
            rows.append((f"j{j}", at(base + 61), "failed", 80, f"broken {j}", None))
    return [*rows, rows[0], rows[3], (None, at(1), "pending", None, None, None)]


def run(spark, stream, checkpoint):
    rows = []
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return rows, query


def test_job_states_equal_the_table(spark, tmp_path):
    events = job_events()
    shuffled = random.Random(2).sample(events, len(events))
    for i in range(3):
        spark.createDataFrame(shuffled[i::3], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = keyed.job_states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), kept_s=1000, stalled_s=20_000)
    rows, _ = run(spark, stream, str(tmp_path / "ck"))
    last = {r["job_id"]: r for _, r in rows if not r["gone"]}
    table = {r["job_id"]: r for r in jobs.job_table(spark.createDataFrame(events, SCHEMA).where("job_id is not null")).collect()}
    names = ["status", "progress", "started_at", "completed_at", "error", "document_id"]
    assert {k: [r[n] for n in names] for k, r in last.items()} == {k: [r[n] for n in names] for k, r in table.items()}
    assert not any(r["gone"] for _, r in rows)

    # An hour's delay later finished jobs end, one late event is left out, the others stay.
    later = [("new", at(10_000), "pending", None, None, None)]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    more, query = run(spark, stream, str(tmp_path / "ck"))
    finished = {k for k, r in table.items() if r["status"] in keyed.FINISHED}
    assert {r["job_id"] for _, r in more if r["gone"]} == finished
    late = [("j2", at(1), "failed", None, "late", None)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    more, _ = run(spark, stream, str(tmp_path / "ck"))
    assert [r for _, r in more if r["job_id"] == "j2"] == []
    spark.createDataFrame([("new", at(60_000), "completed", None, None, 5)], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    more, query = run(spark, stream, str(tmp_path / "ck"))
    gone = {r["job_id"]: r["status"] for _, r in more if r["gone"]}
    assert set(gone) == set(table) - finished
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # the last job's value and timer


def until(check, seconds=150):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(1)
    return False


def read(spark, path, schema=None):
    try:
        return (spark.read.schema(schema).json(path) if schema else spark.read.parquet(path)).collect()
    except Exception:  # nothing written yet
        return []


@pytest.mark.parametrize("restart", [True])
def test_leases(spark, tmp_path, restart):
    paths = {n: str(tmp_path / n) for n in ("in", "out", "acks", "dead", "ck")}
    schema = "job_id string, file_key string, filename string"
    sinks.send(spark.createDataFrame([("good", "k1", "f"), ("good", "k1", "f"), ("bad", "k2", "g"), (None, "k", "x")], schema), paths["in"])

    def handle(df):
        return df.where("job_id != 'bad' or attempt > 3").withColumn("done", F.lit(True))

    def start():
        return keyed.work_leased(jobs.read_inbox(spark, paths["in"]), handle, paths["out"], paths["acks"], paths["dead"], paths["ck"], visible_s=4)

    dead = lambda: read(spark, paths["dead"] + "/*", "job_id string, attempt int, file_key string")
    query = start()
    try:
        assert until(lambda: [r["job_id"] for r in read(spark, paths["out"])] == ["good"])
        if restart:  # leases and counts outlive the query
            query.stop()
            sinks.send(spark.createDataFrame([("good", "k1", "f"), ("third", "k3", "h")], schema), paths["in"])
            query = start()
        assert until(lambda: [(r["job_id"], r["attempt"], r["file_key"]) for r in dead()] == [("bad", 3, "k2")])
    finally:
        query.stop()
    assert query.exception() is None
    assert sorted((r["job_id"], r["attempt"]) for r in read(spark, paths["out"])) == [("good", 1), ("third", 1)]


def test_documents_live(spark, tmp_path):
    """Events and documents as two streams give the batch view once the watermark has passed."""
    docs = "numero_doc int, autores string, event_time timestamp"
    event = lambda job, s, doc: (job, at(s), "completed", None, None, doc)
    paths = str(tmp_path / "events"), str(tmp_path / "docs")

    def put(rows, schema, path):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)

    put([event("a", 0, 1), event("b", 5, 2), event("c", 9, 3), event("d", 9, None)], SCHEMA, paths[0])
    put([(2, "early", at(1)), (9, "nobody's", at(2))], docs, paths[1])
    events, documents = (spark.readStream.schema(s).json(p) for s, p in zip((SCHEMA, docs), paths))
    joined = jobs.job_documents_stream(events, documents, "10 seconds", "1 minute").select("job_id", "autores")

    def step():
        query = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return sorted((r["job_id"], r["autores"]) for r in spark.read.schema("job_id string, autores string").parquet(str(tmp_path / "out")).collect())

    assert step() == [("b", "early")]
    put([(1, "after", at(30))], docs, paths[1])
    assert step() == [("a", "after"), ("b", "early")]
    put([event("z", 1000, 77)], SCHEMA, paths[0])
    put([(88, "far", at(1000))], docs, paths[1])
    step()
    put([event("y", 2000, 78)], SCHEMA, paths[0])
    put([(89, "far", at(2000))], docs, paths[1])
    final = step()
    assert [r for r in final if r[0] < "x"] == [("a", "after"), ("b", "early"), ("c", None)]
