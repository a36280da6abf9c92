"""Task status that moves on its own: a stream of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.functions.common import as_column


def status_stream(tasks: DataFrame, verdicts: DataFrame, ttl_seconds: int = schemas.STATUS_TTL_SECONDS) -> DataFrame:
    """Changes of status: (task_id, created_at, status, verdict, score, at).

    `tasks` has `task_id` and a watermarked `created_at`, `verdicts` has `task_id`, a
    watermarked `decided_at`, `verdict` and `score`. A task is `processing` as it comes, and
    `done` with each verdict within its time to live. Both streams are joined on task and
    interval, so state goes as the watermark passes the time to live; a task that has had no
    verdict by then is `expired`. A verdict without a task, or before it, changes nothing.
    """
    none = [F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("double").alias("score")]
    opened = tasks.select("task_id", "created_at", F.lit("processing").alias("status"), *none, F.col("created_at").alias("at"))
    life = F.expr(f"interval {int(ttl_seconds)} seconds")
    decided = verdicts.select(F.col("task_id").alias("_task"), "decided_at", "verdict", "score")
    within = (F.col("task_id") == F.col("_task")) & (F.col("decided_at") >= F.col("created_at")) & (F.col("decided_at") <= F.col("created_at") + life)
    joined = tasks.select("task_id", "created_at").join(decided, within, "left")
    closed = joined.select(
        "task_id", "created_at", F.when(F.col("_task").isNull(), "expired").otherwise("done").alias("status"), "verdict", "score",
        F.coalesce("decided_at", F.col("created_at") + life).alias("at"),
    )
    return opened.unionByName(closed)


def current_status(changes: DataFrame, now: Column | str, ttl_seconds: int = schemas.STATUS_TTL_SECONDS) -> DataFrame:
    """Status of each task at `now` from the changes so far: the newest verdict counts, until the task's time is over."""
    done = F.col("status") == "done"
    newest = changes.groupBy("task_id", "created_at").agg(F.max(F.when(done, F.struct("at", "verdict", "score"))).alias("last"))
    age = F.unix_micros(as_column(now)) - F.unix_micros("created_at")
    status = F.when(age >= ttl_seconds * 1_000_000, "expired").when(F.col("last").isNotNull(), "done").otherwise("processing")
    alive = F.col("status") == "done"
    return newest.withColumn("status", status).select(
        "task_id", "status", F.when(alive, F.col("last.verdict")).alias("verdict"), F.when(alive, F.col("last.score")).alias("score")
    )
