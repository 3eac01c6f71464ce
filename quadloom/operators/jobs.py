"""Ingestion jobs: the latest of each content, the reader's filter, lists, and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.common import first_by
from quadloom.schemas import DONE_STATES


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Of each content the newest job; ties by job_id. One aggregation, without a window's sort."""
    own = F.struct("created_at", *(c for c in jobs.columns if c not in ("created_at", "content_id")))
    return jobs.groupBy("content_id").agg(F.max(own).alias("_job")).select("content_id", "_job.*")


def readable(content: DataFrame, jobs: DataFrame, on: bool = True) -> DataFrame:
    """Contents without a job or whose latest job is done; all of them if the filter is off."""
    if not on:
        return content
    latest = latest_jobs(jobs).select("content_id", F.col("status").alias("_status"))
    return content.join(latest, "content_id", "left").where(F.col("_status").isNull() | F.col("_status").isin(*DONE_STATES)).drop("_status")


def job_list(jobs: DataFrame, content: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """The newest jobs with their contents' titles."""
    if status:
        jobs = jobs.where(F.col("status") == status)
    return jobs.join(content, "content_id").orderBy(F.desc("created_at"), "job_id").limit(min(limit, 200))


def accepted(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each request with the job that serves it: the content's active job, else a new one of its own (the first by seq)."""
    active = first_by(jobs.where(~F.col("status").isin(*DONE_STATES)), ["content_id"], "created_at", "job_id").select("content_id", F.col("job_id").alias("_active"))
    first = first_by(new, ["content_id"], "seq").select("content_id", F.col("job_id").alias("_first"))
    out = new.join(active, "content_id", "left").join(first, "content_id").withColumn("serving_job", F.coalesce("_active", "_first"))
    return out.withColumn("reused", F.col("serving_job") != F.col("job_id")).drop("_active", "_first")


def finished(status: Column, new_status: Column) -> Column:
    """A job that is done keeps its state."""
    return F.when(status.isin(*DONE_STATES), status).otherwise(new_status)


def recovered(jobs: DataFrame, message: str = "interrupted") -> DataFrame:
    """After a restart: jobs that aren't done have failed."""
    active = ~F.col("status").isin(*DONE_STATES)
    error = F.to_json(F.struct(F.lit(message).alias("message"), F.col("status").alias("phase")))
    return jobs.withColumns({"error": F.when(active, error).otherwise(F.col("error")), "status": F.when(active, "failed").otherwise(F.col("status"))})
