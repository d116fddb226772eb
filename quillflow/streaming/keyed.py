"""Keyed state with an end: the state of jobs by events, and the delivery of queue messages.

Both are state machines for each job (``transformWithState``): values in the state store,
timers that end them, nothing kept for jobs that are over. They need the RocksDB state store,
which ``with_state_store`` sets where the session names no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.schema import JOB_STATES
from ..sources.shared import ship
from .jobs import MOST_ATTEMPTS, progress_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400
FINISHED = ("completed", "failed")
#: As ``job_table`` has them, and whether the row says that the job's state ended. Times are
#: microseconds here, so that no time zone of a Python worker matters.
JOB_ROW = "job_id string, status string, progress int, started_at long, completed_at long, error string, document_id int, gone boolean"
_JOB_VALUE = (
    "at long, n int, p int, status string, progress int, processing long, analyzing long, completed_at long, "
    "error_at long, error_n int, error_p int, error string, document_at long, document_n int, document_p int, document_id int"
)


def with_state_store(spark: SparkSession) -> None:
    ship(spark)
    if spark.conf.get(_PROVIDER, "").rsplit(".", 1)[-1] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def _end(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer for the key, at this time."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at_ms)


def _plain(v):
    """A cell of a batch as a state value: nothing as None."""
    return None if v is None or (isinstance(v, float) and v != v) else v


class JobStates(StatefulProcessor):
    """One job's state after each batch of its events, weighed by their times as in ``job_table``."""

    def __init__(self, kept_s: int, stalled_s: int):
        self.kept_s, self.stalled_s = kept_s, stalled_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("job", _JOB_VALUE)
        self.names = [c.split()[0] for c in _JOB_VALUE.split(", ")]

    def _row(self, key, s: dict, gone: bool) -> pd.DataFrame:
        started = s["analyzing"] if s["processing"] is None else s["processing"]
        row = [key[0], s["status"], s["progress"], started, s["completed_at"], s["error"], s["document_id"], gone]
        out = pd.DataFrame([row], columns=[c.split()[0] for c in JOB_ROW.split(", ")])
        return out.astype({"progress": "Int32", "document_id": "Int32", "started_at": "Int64", "completed_at": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(self.names, self.value.get())) if self.value.exists() else dict.fromkeys(self.names)
        for frame in rows:
            for e in frame.itertuples(index=False):
                at, status = int(e.at), e.status
                stated = _plain(e.stated)
                order = (at, int(e.n), -1 if stated is None else int(stated))
                if s["at"] is None or order > (s["at"], s["n"], s["p"]):
                    s["at"], s["n"], s["p"] = order
                    s["status"], s["progress"] = status, int(e.progress)
                for name, value in (("error", _plain(e.error)), ("document", _plain(e.document_id))):
                    known = tuple(s[f"{name}_{x}"] for x in ("at", "n", "p"))
                    if value is not None and (known[0] is None or order > known):
                        s[f"{name}_at"], s[f"{name}_n"], s[f"{name}_p"] = order
                        s["error" if name == "error" else "document_id"] = value if name == "error" else int(value)
                for name, of, best in (("processing", ("processing",), max), ("analyzing", ("analyzing",), min), ("completed_at", FINISHED, max)):
                    if status in of:
                        s[name] = at if s[name] is None else best(s[name], at)
        self.value.update(tuple(s[n] for n in self.names))
        over = s["status"] in FINISHED
        _end(self.handle, max(s["at"] // 1000 + 1000 * (self.kept_s if over else self.stalled_s), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = dict(zip(self.names, self.value.get()))
        self.value.clear()
        yield self._row(key, s, True)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, delay: str = "1 hour", kept_s: int = DAY, stalled_s: int = 14 * DAY) -> DataFrame:
    """The state of each job that a micro-batch changes (output mode update), with an end.

    Events count by their time, in whatever order they come and however often; those without a
    job or time, and those later than ``delay`` behind the newest event of all, are left out. A
    finished job's state ends ``kept_s`` seconds after its last event, another's ``stalled_s``
    seconds after it; then one row with ``gone`` says so, and an event after that (which the
    delay lets through only within ``delay``) starts the job anew. Until then the rows equal
    those of ``jobs.job_table`` over the same events.
    """
    with_state_store(events.sparkSession)
    order = F.array_position(F.array(*[F.lit(x) for x in JOB_STATES]), F.col("status"))
    time = F.col("event_time").cast("timestamp")
    ready = events.where("job_id is not null and event_time is not null").select(
        "job_id", time.alias("event_time"), F.unix_micros(time).alias("at"), "status", order.cast("int").alias("n"), F.col("progress").alias("stated"), progress_of(F.col("status"), F.col("progress")).alias("progress"), "error", "document_id"
    )
    states = ready.withWatermark("event_time", delay).groupBy("job_id").transformWithStateInPandas(JobStates(kept_s, stalled_s), JOB_ROW, "Update", "EventTime")
    return states.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "completed_at")})


# --- delivery ----------------------------------------------------------------------------------

DELIVERY = "job_id string, file_key string, filename string, attempt int, outcome string"


class Lease(StatefulProcessor):
    """One message: handed out, hidden for a time, handed out again unless acknowledged, and
    after the last time a dead letter."""

    def __init__(self, visible_s: float, most: int, kept_s: float):
        self.visible_ms, self.most, self.kept_ms = int(1000 * visible_s), most, int(1000 * kept_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("message", "file_key string, filename string, attempt int, over boolean")

    def _given(self, key, file_key, filename, attempt: int, now: int) -> pd.DataFrame:
        dead = attempt > self.most
        self.value.update((file_key, filename, min(attempt, self.most), dead))
        _end(self.handle, now + (self.kept_ms if dead else self.visible_ms))
        row = (key[0], file_key, filename, min(attempt, self.most), "dead" if dead else "deliver")
        return pd.DataFrame([row], columns=["job_id", "file_key", "filename", "attempt", "outcome"]).astype({"attempt": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        message, acknowledged = None, False
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.acknowledged:
                    acknowledged = True
                elif message is None:
                    message = (_plain(r.file_key), _plain(r.filename))
        known = self.value.get() if self.value.exists() else None
        if acknowledged:
            file_key, filename, attempt, _ = known or (*(message or (None, None)), 0, False)
            self.value.update((file_key, filename, attempt, True))
            _end(self.handle, now + self.kept_ms)
        elif known is None and message is not None:
            yield self._given(key, *message, 1, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        file_key, filename, attempt, over = self.value.get()
        if over:
            self.value.clear()
        else:
            yield self._given(key, file_key, filename, attempt + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def deliveries(messages: DataFrame, acknowledged: DataFrame, visible_s: float = 900, most: int = MOST_ATTEMPTS, kept_s: float = 14 * DAY) -> DataFrame:
    """(job_id, file_key, filename, attempt, outcome) of messages to work on and dead letters.

    A job's first message is handed out at once, further ones are its repeats. What is not
    acknowledged (a row of ``acknowledged`` with its job_id) within ``visible_s`` seconds is handed
    out again, ``most`` times in all; then it comes as a dead letter. Acknowledged and dead jobs
    are remembered for ``kept_s`` seconds, so that repeats in that time do nothing. Rows without
    a job are left out. Output mode append.
    """
    with_state_store(messages.sparkSession)
    nothing = F.lit(None).cast("string")
    both = messages.select("job_id", "file_key", "filename", F.lit(False).alias("acknowledged")).unionByName(
        acknowledged.select("job_id", nothing.alias("file_key"), nothing.alias("filename"), F.lit(True).alias("acknowledged"))
    )
    return both.where("job_id is not null").groupBy("job_id").transformWithStateInPandas(Lease(visible_s, most, kept_s), DELIVERY, "Append", "ProcessingTime")


def work_leased(
    messages: DataFrame,
    handle: Callable[[DataFrame], DataFrame],
    out: str,
    acknowledgements: str,
    dead_letters: str,
    checkpoint: str,
    every: str = "1 second",
    visible_s: float = 900,
    most: int = MOST_ATTEMPTS,
) -> StreamingQuery:
    """Works on messages until stopped; dead letters are the second output of the same stream.

    ``handle`` gets a batch's messages and gives back rows with the job_id of what it has done;
    these are written under the batch's number, so a batch that runs again replaces its rows, and
    then acknowledged by JSON lines in a folder that the stream reads as well. What it leaves out
    comes again. Delivery is at least once: a job whose acknowledgement comes after its time is
    handed out twice, as the queue does.
    """
    spark = messages.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(acknowledgements)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)
    said = spark.readStream.schema("job_id string").json(acknowledgements)

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            df.where("outcome = 'dead'").drop("outcome").write.mode("overwrite").json(f"{dead_letters}/batch={number}")
            handle(df.where("outcome = 'deliver'").drop("outcome")).write.mode("overwrite").parquet(f"{out}/batch={number}")
            done = df.sparkSession.read.parquet(f"{out}/batch={number}").select("job_id").distinct()
            done.write.mode("append").json(acknowledgements)
        finally:
            df.unpersist()

    given = deliveries(messages, said, visible_s, most)
    return given.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

