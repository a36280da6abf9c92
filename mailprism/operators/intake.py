"""Intake of raw tasks: size rule and stamping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.common import iso_utc

# Accepted text length in characters.
MIN_CHARS = 10
MAX_CHARS = 50_000


def intake_rejection(text: str = "text") -> Column:
    """Why a text is refused, NULL when it is accepted."""
    size = F.length(text)
    return (
        F.when(F.col(text).isNull(), F.lit("text is missing"))
        .when(size < MIN_CHARS, F.lit(f"text shorter than {MIN_CHARS} characters"))
        .when(size > MAX_CHARS, F.lit(f"text longer than {MAX_CHARS} characters"))
    )


def validate_intake(tasks: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Accepted tasks, and refused ones with their `rejection`."""
    checked = tasks.withColumn("rejection", intake_rejection(text))
    return checked.filter(F.col("rejection").isNull()).drop("rejection"), checked.filter(
        F.col("rejection").isNotNull()
    )


def stamp_tasks(tasks: DataFrame, *keys: str, created_at: Column | None = None, random_ids: bool = False) -> DataFrame:
    """Add `task_id` and `created_at`.

    The id is a hash of the key columns, so a task re-run after a lost executor keeps it;
    `random_ids` gives UUIDs instead.
    """
    if random_ids:
        task_id = F.expr("uuid()")
    else:
        task_id = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256)
    moment = F.current_timestamp() if created_at is None else created_at
    return tasks.withColumn("task_id", task_id).withColumn("created_at", iso_utc(moment))
