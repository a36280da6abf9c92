"""Verdicts from aggregates, their table form, lookups and task status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.functions import verdict as V
from mailprism.functions.common import as_column, iso_utc
from mailprism.operators.correlate import latest_per_key


def usable_aggregates(aggregates: DataFrame) -> DataFrame:
    """Aggregates with a task id and at least one result; others are skipped, not reported."""
    return aggregates.filter(
        (F.coalesce(F.col("task_id"), F.lit("")) != "") & (F.coalesce(F.size("results"), F.lit(0)) > 0)
    )


def _figures(aggregates: DataFrame) -> tuple[Column, Column]:
    """Mean and number of results: of the whole task where the rows say so, else of the row."""
    if "n_results" in aggregates.columns:
        return F.col("total").cast("double") / F.col("n_results"), F.col("n_results")
    return V.mean_score(V.individual_scores("results")), F.size("results")


def decide(aggregates: DataFrame, decided_at: Column | None = None, checked: bool = False) -> DataFrame:
    """One verdict row per aggregate, stateless.

    Aggregates of `nest_results` give one row per task whatever its size: mean, count and
    verdict are of the whole task, the arrays those of its first chunk; `verdict_details`
    has the arrays of all chunks. `checked` says that every row is usable. Aggregates
    scored in the same query are, and a filter on their results would be pushed below the
    scoring and run it twice.
    """
    moment = F.current_timestamp() if decided_at is None else decided_at
    usable = aggregates if checked else usable_aggregates(aggregates)
    if "chunk" in aggregates.columns:
        usable = usable.filter("chunk = 0")
    mean, count = _figures(aggregates)
    scored = usable.withColumns({"_mean": mean, "_count": count})
    return scored.select(
        "task_id",
        V.verdict("_mean").alias("verdict"),
        V.rounded_score("_mean").alias("score"),
        F.col("_count").alias("analyzer_count"),
        V.individual_scores("results").alias("individual_scores"),
        V.explain("results").alias("reasons"),
        iso_utc(moment).alias("decided_at"),
    )


def verdict_details(aggregates: DataFrame) -> DataFrame:
    """Scores and reasons of all results, one row per task and chunk."""
    return usable_aggregates(aggregates).select(
        "task_id", "chunk", V.individual_scores("results").alias("individual_scores"), V.explain("results").alias("reasons")
    )


def split_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts, and dead letters of means that no level of the scale covers."""
    none = F.lit(None).cast("string")
    outside = verdicts.filter(F.col("verdict").isNull()).select(
        "task_id",
        F.lit("mean score outside the verdict scale").alias("reason"),
        F.col("decided_at").alias("at"),
        none.alias("topic"),
        none.alias("error"),
        none.alias("raw"),
    )
    return verdicts.filter(F.col("verdict").isNotNull()), outside


def to_verdict_row(verdicts: DataFrame) -> DataFrame:
    """Projection onto the verdict table; the cluster is not known at this point."""
    blob = F.to_json(F.struct(*[F.col(c) for c in schemas.VERDICT.names]))
    return verdicts.select(
        F.col("task_id").alias("email_id"),
        F.col("verdict").alias("overall_risk"),
        F.col("score").alias("ai_assistance_score"),
        F.col("verdict").alias("classification"),
        F.lit(None).cast("string").alias("cluster_id"),
        blob.alias("full_verdict"),
        F.to_timestamp("decided_at").alias("decided_at"),
    )


def _by_kind(results: Column | str) -> Column:
    """One entry per analyzer: its last result, and whether any of its scores is high."""
    kind_of = lambda r: F.coalesce(r["analyzer_type"], F.lit("?"))

    def entry(kind: Column) -> Column:
        mine = F.filter(results, lambda r: kind_of(r) == kind)
        high = F.exists(mine, lambda r: F.coalesce(V.countable(r["score"]) > 0.5, F.lit(False)))
        return F.struct(kind.alias("kind"), F.element_at(mine, -1).alias("last"), high.alias("high"))

    return F.transform(F.array_distinct(F.transform(results, kind_of)), entry)


def full_verdict(
    aggregates: DataFrame, campaigns: DataFrame | None = None, decided_at: Column | None = None, model_version: str = schemas.MODEL_VERSION
) -> DataFrame:
    """The declared verdict contract: signals by analyzer, campaign, rules, model version.

    Of several results of one analyzer the last one is the signal. `campaigns` holds one
    row per `email_id`. One row per aggregate; the chunks of a large task are one row, which
    holds an entry per analyzer, not per result.
    """
    mean, _ = _figures(aggregates)
    usable = usable_aggregates(aggregates)
    if "chunk" in aggregates.columns:
        kinds = usable.select("task_id", "chunk", "n_results", "total", F.explode(_by_kind("results")).alias("k"))
        kinds = kinds.groupBy("task_id", "n_results", "total", "k.kind").agg(
            F.max_by("k.last", "chunk").alias("last"), F.bool_or("k.high").alias("high")
        )
        usable = kinds.groupBy("task_id", "n_results", "total").agg(
            F.collect_list(F.struct("kind", "last", "high")).alias("_kinds")
        )
    else:
        usable = usable.withColumn("_kinds", _by_kind("results"))
    signals = F.map_from_entries(F.transform("_kinds", lambda k: F.struct(k["kind"].alias("key"), k["last"].alias("value"))))
    rules = F.transform(F.filter("_kinds", lambda k: k["high"]), lambda k: k["kind"])
    moment = F.current_timestamp() if decided_at is None else decided_at
    joined = usable.select(
        F.col("task_id").alias("email_id"), mean.alias("_mean"), signals.alias("signals"), F.sort_array(rules).alias("rules_applied")
    )
    none = F.struct(
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(0).alias("variations_detected"),
        F.lit(None).cast("string").alias("pattern"),
    )
    if campaigns is None:
        context = none
    else:
        known = campaigns.select(
            "email_id", F.struct("cluster_id", F.col("variations_detected").cast("int").alias("variations_detected"), "pattern").alias("_campaign")
        )
        joined = joined.join(known, "email_id", "left")
        context = F.coalesce(F.col("_campaign"), none)
    return joined.select(
        "email_id",
        V.verdict("_mean").alias("overall_risk"),
        V.rounded_score("_mean").alias("ai_assistance_score"),
        V.verdict("_mean").alias("classification"),
        "signals",
        context.alias("campaign_context"),
        "rules_applied",
        F.lit(model_version).alias("model_version"),
        iso_utc(moment).alias("decided_at"),
    )


def latest_verdicts(rows: DataFrame, n: int = 5) -> DataFrame:
    """The newest verdicts of the table; a top-n, not a full sort."""
    return rows.orderBy(F.col("decided_at").desc(), F.col("email_id")).limit(n)


def verdicts_of(rows: DataFrame, email_id: str) -> DataFrame:
    """All verdicts of one message; the filter reaches the scan."""
    return rows.filter(F.col("email_id") == email_id)


def task_status(
    tasks: DataFrame, verdicts: DataFrame, now: Column | str, ttl_seconds: int = schemas.STATUS_TTL_SECONDS
) -> DataFrame:
    """Status of each task: `expired` after its time to live, else `done` or `processing`.

    `tasks` has `task_id` and a timestamp `created_at`; the newest verdict of a task counts.
    """
    newest = latest_per_key(verdicts.select("task_id", "decided_at", "verdict", "score"), "task_id", "decided_at")
    age = F.unix_micros(as_column(now)) - F.unix_micros("created_at")
    status = (
        F.when(age >= ttl_seconds * 1_000_000, F.lit("expired"))
        .when(F.col("verdict").isNotNull(), F.lit("done"))
        .otherwise(F.lit("processing"))
    )
    alive = F.col("status") == "done"
    return (
        tasks.select("task_id", "created_at")
        .join(newest, "task_id", "left")
        .withColumn("status", status)
        .select(
            "task_id",
            "status",
            F.when(alive, F.col("verdict")).alias("verdict"),
            F.when(alive, F.col("score")).alias("score"),
        )
    )


def envelope(rows: DataFrame, producer: str, email_id: str, produced_at: Column | None = None) -> DataFrame:
    """Wrap rows in the declared message envelope; the id is a hash of its content."""
    moment = iso_utc(F.current_timestamp() if produced_at is None else produced_at)
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(producer), F.col(email_id), payload), 256).alias("message_id"),
        F.col(email_id).cast("string").alias("email_id"),
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"),
        F.lit(producer).alias("producer"),
        payload.alias("payload"),
        moment.alias("produced_at"),
    )
