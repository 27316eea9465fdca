"""Streams of jobs and events into tables, a batch at a time.

Batches carry their number, and every table has it as a column: a batch that runs again after a lost driver replaces
its own rows (dynamic partition overwrite), so nothing is written twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .run_state import project


def _put(batch: DataFrame, number: int, path: str) -> None:
    batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def sink_events(events: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of run events (run_id, sequence, type, stage, error) to ``events``, and what each batch says of its
    runs to ``run_changes`` (run_id, status, stage, error, last_sequence). ``latest_runs`` gives each run's last."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            _put(batch, number, f"{folder}/events")
            _put(project(batch), number, f"{folder}/run_changes")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_runs(changes: DataFrame) -> DataFrame:
    """The last state of each run in a table of changes: by batch (its number grows), a final status staying."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_sequence"))).alias(c)
    return changes.groupBy("run_id").agg(last("status"), last("stage"), last("error"), F.max("last_sequence").alias("last_sequence"))


def run_jobs(jobs: DataFrame, handle: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``handle`` on each batch of a stream of jobs (job_id, ...) and writes its rows (job_id, status, error).

    Where a batch fails its jobs run one by one, and those that fail again are written as failed with the error: the
    stream goes on. A batch holds as many jobs as the source's limit a trigger allows. A batch may run more than once
    after a lost driver; its rows are replaced."""

    def alone(batch: DataFrame, job) -> list[tuple]:
        try:
            return [tuple(r) for r in handle(batch.where(F.col("job_id").eqNullSafe(F.lit(job)))).select("job_id", "status", "error").collect()]
        except Exception as failure:  # any failure of a job ends that job, not the loop
            return [(job, "failed", str(failure))]

    def write(batch: DataFrame, number: int) -> None:
        try:
            _put(handle(batch).select("job_id", "status", "error"), number, f"{folder}/jobs")
        except Exception:  # of at least one job: which one shows when each runs alone
            rows = [r for j in batch.select("job_id").distinct().collect() for r in alone(batch, j.job_id)]
            kind = batch.schema["job_id"].dataType.simpleString()
            _put(batch.sparkSession.createDataFrame(rows, f"job_id {kind}, status string, error string"), number, f"{folder}/jobs")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
