"""Batch correlation of analyzer results per task, and arrival positions.

A task normally holds a handful of results, but nothing on the wire forbids one id from
holding a third of them. So the figures of a task come from aggregates that combine before
the shuffle, and arrays are only collected in chunks of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.functions.common import as_column, round_half_even
from mailprism.functions.verdict import countable, verdict
from mailprism.operators.ranking import ranked_in_slots

_RESULT_FIELDS = ["analyzer_type", "score", "features", "reason", "analyzed_at"]


def union_branches(*branches: DataFrame) -> DataFrame:
    """All analyzer results as one frame."""
    whole, *others = branches
    for branch in others:
        whole = whole.unionByName(branch)
    return whole


def exact_total(score: str) -> Column:
    """Sum of scores as a decimal; one that is missing or cannot be counted adds nothing."""
    return F.sum(F.coalesce(countable(score).try_cast("decimal(28,18)"), F.lit(0).cast("decimal(28,18)")))


def correlate(results: DataFrame, expected: int = schemas.EXPECTED_ANALYZERS) -> DataFrame:
    """Figures per task: results, distinct types, mean score, completeness, verdict.

    One hash aggregation on `task_id`. Scores are added as decimals, which makes the sum
    exact and independent of the order partial sums are combined in.
    """
    grouped = results.groupBy("task_id").agg(
        F.count("*").cast("int").alias("analyzer_count"),
        # collect_set holds one entry per analyzer type, not per result.
        F.size(F.collect_set(F.coalesce("analyzer_type", F.lit("")))).alias("n_types"),
        exact_total("score").alias("total"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    )
    mean = F.col("total").cast("double") / F.col("analyzer_count")
    return grouped.withColumn("_mean", mean).select(
        "task_id",
        "analyzer_count",
        "n_types",
        (F.col("n_types") >= expected).alias("complete"),
        "first_ms",
        "last_ms",
        round_half_even("_mean", 3).alias("score"),
        verdict("_mean").alias("verdict"),
    )


def arrival_positions(
    results: DataFrame, key: str = "task_id", ts: str = "ts_ms", seq: str = "seq", slot_ms: int = 3_600_000
) -> DataFrame:
    """Add `position`, the one-based arrival rank of a result in its task."""
    return ranked_in_slots(results, [key], F.floor(F.col(ts) / slot_ms), [ts, seq], "position")


def nest_results(results: DataFrame, max_rows: int = 10_000, slot_ms: int = 3_600_000) -> DataFrame:
    """Results of a task as arrays in arrival order, with the figures of the whole task.

    A row holds at most `max_rows` results; a task with more goes on in the rows with
    `chunk` 1, 2, … so that nothing is dropped and no group outgrows a task. `n_results` and
    `total`, the exact sum of the scores, are of all chunks and the same in each.
    """
    chunk = F.floor((F.col("position") - 1) / max_rows).cast("int")
    placed = arrival_positions(results, slot_ms=slot_ms).withColumn("chunk", chunk)
    items = F.sort_array(F.collect_list(F.struct("position", *_RESULT_FIELDS)))
    nested = placed.groupBy("task_id", "chunk").agg(items.alias("_items"))
    figures = results.groupBy(F.col("task_id").alias("_task")).agg(
        F.count("*").cast("int").alias("n_results"), exact_total("score").alias("total")
    )
    return nested.join(figures, F.col("task_id").eqNullSafe(F.col("_task"))).select(
        "task_id",
        "chunk",
        F.transform("_items", lambda i: F.struct(*[i[f].alias(f) for f in _RESULT_FIELDS])).alias("results"),
        "n_results",
        "total",
    )


def first_arrivals(
    results: DataFrame,
    timeout_ms: int = schemas.TASK_TIMEOUT_MS,
    expected: int = schemas.EXPECTED_ANALYZERS,
) -> DataFrame:
    """First arrival, deadline and moment of completion of each task's first life.

    The running number of distinct types reaches `expected` when the `expected`-th type is
    first seen, so the earliest stamp per (task, type) is all that is ranked: at most one
    row per analyzer type, whatever the number of results.
    """
    firsts = results.groupBy("task_id", "analyzer_type").agg(F.min("ts_ms").alias("ts_ms"))
    running = Window.partitionBy("task_id").orderBy("ts_ms", "analyzer_type")
    ranked = firsts.withColumn("types_seen", F.row_number().over(running))
    return ranked.groupBy("task_id").agg(
        F.min("ts_ms").alias("first_ms"),
        (F.min("ts_ms") + timeout_ms).alias("deadline_ms"),
        F.min(F.when(F.col("types_seen") == expected, F.col("ts_ms"))).alias("filled_ms"),
        F.max("types_seen").alias("n_types"),
    ).withColumn("in_time", F.coalesce(F.col("filled_ms") < F.col("deadline_ms"), F.lit(False)))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest `order`, combined before the shuffle."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(as_column(order), *others)).alias("_best")
    return rows.groupBy(key).agg(best).select(key, "_best.*")
