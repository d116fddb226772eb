"""Jobs: their states from events, in batch and as a stream, and the queue's worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import JOB_EVENT, MESSAGE

MOST_ATTEMPTS = 3


def new_jobs(messages: DataFrame, kind: str = "pdf") -> DataFrame:
    """Pending jobs for files, with fresh ids."""
    return messages.select(
        F.uuid().alias("job_id"),
        "file_key",
        "filename",
        F.lit(kind).alias("job_type"),
        F.lit("pending").alias("status"),
        F.lit(0).alias("progress"),
        F.current_timestamp().alias("created_at"),
    )


def progress_of(status: Column, progress: Column) -> Column:
    """The progress an event sets: stated, or the state's own (completed 100, failed 0)."""
    return (
        F.when(status == "completed", 100)
        .when(status == "failed", 0)
        .when(status == "processing", F.coalesce(progress, F.lit(10)))
        .when(status == "analyzing", F.coalesce(progress, F.lit(40)))
        .otherwise(F.coalesce(progress, F.lit(0)))
    )


def reference_progress(index: Column, total: Column) -> Column:
    """30 to 90 by the references done."""
    return (30 + F.floor(60 * index / total)).cast("int")


def job_table(events: DataFrame) -> DataFrame:
    """The state of every job after all its events, by one aggregation.

    The latest event gives status and progress; started_at is the last start (the first
    analysis only if nothing started before); errors and documents are the last stated.
    Events of equal time count in the order of the states.
    """
    order = F.struct(
        "event_time",
        F.array_position(F.array(*[F.lit(s) for s in ("pending", "processing", "analyzing", "completed", "failed")]), F.col("status")).alias("n"),
        F.coalesce("progress", F.lit(-1)).alias("p"),
    )
    at = lambda *states: F.when(F.col("status").isin(*states), F.col("event_time"))
    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by(progress_of(F.col("status"), F.col("progress")), order).alias("progress"),
        F.coalesce(F.max(at("processing")), F.min(at("analyzing"))).alias("started_at"),
        F.max(at("completed", "failed")).alias("completed_at"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("error"),
        F.max_by("document_id", F.when(F.col("document_id").isNotNull(), order)).alias("document_id"),
    )


def job_message(status: Column, progress: Column, error: Column) -> Column:
    p = F.concat(progress.cast("string"), F.lit("%"))
    return (
        F.when(status == "pending", "Esperando procesamiento...")
        .when(status == "processing", F.concat(F.lit("Procesando... "), p))
        .when(status == "analyzing", F.concat(F.lit("Analizando contenido del PDF... "), p))
        .when(status == "completed", "Procesamiento completado")
        .when(status == "failed", F.concat(F.lit("Error: "), F.coalesce(error, F.lit("Error desconocido"))))
        .otherwise(F.concat(F.lit("Estado desconocido: "), F.coalesce(status, F.lit("None"))))
    )


def job_status(jobs: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Jobs with their message and, where they have one, the document as a struct."""
    out = jobs.withColumn("message", job_message(F.col("status"), F.col("progress"), F.col("error")))
    if documents is None:
        return out
    docs = documents.select(F.col("numero_doc").alias("__n"), F.struct(*documents.columns).alias("document"))
    return out.join(docs, F.col("document_id") == F.col("__n"), "left").drop("__n")


def job_documents_stream(events: DataFrame, documents: DataFrame, delay: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Each event that names a document, with the document, as both arrive (output mode append).

    Both streams have an ``event_time`` and are late by ``delay`` at most. A document counts if it
    comes within ``within`` of its event, before or after; an event whose document does not comes
    without one once the watermark is past that, and rows later than the watermark are left out.
    """
    own = events.where("document_id is not null").withWatermark("event_time", delay).alias("e")
    docs = documents.select(*[F.col(f"`{c}`").alias("doc_time" if c == "event_time" else c) for c in documents.columns]).withWatermark("doc_time", delay).alias("d")
    near = F.expr(f"e.document_id = d.numero_doc and d.doc_time between e.event_time - interval {within} and e.event_time + interval {within}")
    return own.join(docs, near, "leftOuter")


def job_stream(events: DataFrame) -> DataFrame:
    """The same states from a stream of events, one row for each job that a micro-batch changes
    (output mode update); ``keyed.job_states`` says which events are late and when state ends."""
    from .keyed import job_states

    return job_states(events).where("not gone").drop("gone")


def read_inbox(spark: SparkSession, inbox: str, per_batch: int = 1000) -> DataFrame:
    """Queue messages as a stream; messages that can't be read or lack a job are left out."""
    lines = spark.readStream.schema(MESSAGE).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_batch).json(inbox)
    return lines.where("job_id is not null and file_key is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOB_EVENT).json(path)


def routed(attempts: DataFrame, most: int = MOST_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """One row for each job to work on, with its attempt, and the jobs beyond the last one."""
    latest = attempts.groupBy("job_id").agg(
        F.max("attempt").alias("attempt"), F.max_by("file_key", "attempt").alias("file_key"), F.max_by("filename", "attempt").alias("filename")
    )
    return latest.where(F.col("attempt") < most), latest.where(F.col("attempt") >= most)


def work(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, remembered: str = "14 days"):
    """Runs ``handle`` on every micro-batch and keeps its rows under the batch's number, so a
    batch that runs again replaces its rows. A job counts once: the query's state remembers its
    id for as long as the queue keeps messages. ``keyed.work_leased`` hands out again what is
    not acknowledged."""
    received = messages.withColumn("received_at", F.current_timestamp()).withWatermark("received_at", remembered)
    fresh = received.dropDuplicatesWithinWatermark(["job_id"]).drop("received_at")

    def batch(df: DataFrame, number: int) -> None:
        handle(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
