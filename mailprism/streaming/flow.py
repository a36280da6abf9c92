"""Streams from raw tasks to results, aggregates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.operators import results as R
from mailprism.operators.verdicts import decide
from mailprism.plans.scoring import result_rows, score_messages


def task_stream(messages: DataFrame) -> DataFrame:
    """Raw tasks of a message stream; malformed ones and those without id are skipped."""
    decoded = R.decode_messages(messages, schemas.RAW_TASK)
    return R.flatten(decoded.filter(F.col("valid") & F.col("data.task_id").isNotNull()))


def score_stream(messages: DataFrame, at: Column | None = None, exact: bool = True, **model_and_domains) -> DataFrame:
    """Results of all analyzers; stateless, one source for all of them.

    `model_and_domains` are those of `score_messages`.
    """
    return result_rows(score_messages(task_stream(messages), at, exact, **model_and_domains))


def result_stream(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted results of the analysis topics, and the dead letters of malformed ones."""
    decoded = R.decode_messages(messages, schemas.RESULT)
    valid, dead = R.split_dlq(decoded)
    stamped = valid.withColumn("ts_ms", F.unix_millis("timestamp"))
    return R.accept_results(stamped), dead


def verdict_stream(aggregates: DataFrame, decided_at: Column | None = None, checked: bool = False) -> DataFrame:
    """Verdicts of a stream of aggregates; stateless."""
    return decide(aggregates, decided_at, checked)


def aggregate_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aggregates read back from their topic, and the dead letters of malformed ones."""
    decoded = R.decode_messages(messages, schemas.AGGREGATE)
    valid, dead = R.split_dlq(decoded)
    return R.flatten(valid), dead
