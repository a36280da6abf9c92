"""Analyzer results: decoding, dead letters, defaults, contract check, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism import schemas
from mailprism.functions.common import as_column, iso_utc, let
from mailprism.functions.verdict import countable

_CORRUPT = "_corrupt"
_END = "end-of-message"
# Strings in a message may be as long as a message.
_NO_LIMIT = {"maxStringLen": str(2**31 - 1)}
NOT_AN_OBJECT = "deserialization failed: not a JSON object"
UNCOUNTABLE = "score is not a finite number of usable size"


def decode_messages(messages: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Replace `value` by `raw`, `valid` and the decoded struct `data`.

    A message is valid when it is UTF-8 and one JSON object whose fields fit the schema.
    `[1]` would decode to a struct of NULLs, so the opening brace is asked for as well.
    Spark's parsers stop at the end of the object; put into an array before a last element,
    the message must be followed by that element and nothing else. The array is one of
    plain JSON texts, which has no limit of size.
    """
    text = F.col(value).cast("string")
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = messages.withColumn("raw", F.make_valid_utf8(text)).withColumn(
        "data", F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, **_NO_LIMIT})
    )
    followed = F.concat(F.lit("["), F.col("raw"), F.lit(f',"{_END}"]'))
    valid = (
        F.is_valid_utf8(text)
        & F.rlike(F.col("raw"), F.lit(r"^\s*+\{"))
        & F.col(f"data.{_CORRUPT}").isNull()
        & let(F.from_json(followed, "array<string>", _NO_LIMIT), lambda a: (F.size(a) == 2) & (F.get(a, F.lit(1)) == _END))
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False))).drop(value)


def flatten(decoded: DataFrame, *carry: str) -> DataFrame:
    """The decoded fields as columns, then the `carry` columns.

    Each field is taken from the struct; rebuilding the struct without its marker would
    decode the message once per field.
    """
    names = [n for n in decoded.schema["data"].dataType.names if n != _CORRUPT]
    return decoded.select(*[F.col(f"data.{n}").alias(n) for n in names], *carry)


def uncountable_letters(results: DataFrame, score: str = "score") -> DataFrame:
    """Dead-letter rows of results whose score cannot be counted; verdicts take it as zero."""
    none = F.lit(None).cast("string")
    return results.filter(F.col(score).isNotNull() & countable(score).isNull()).select(
        F.col("task_id"), F.lit(UNCOUNTABLE).alias("reason"), none.alias("at"), none.alias("topic"),
        F.col(score).cast("string").alias("error"), none.alias("raw"),
    )


def malformed_letters(decoded: DataFrame, topic: str = "topic") -> DataFrame:
    """Dead-letter rows of the messages that could not be decoded."""
    return decoded.filter(~F.col("valid")).select(
        F.lit(None).cast("string").alias("task_id"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("at"),
        F.col(topic).alias("topic"),
        F.lit(NOT_AN_OBJECT).alias("error"),
        F.col("raw"),
    )


def timeout_letters(episodes: DataFrame, at: Column | str) -> DataFrame:
    """Dead-letter rows of tasks whose deadline passed; what was collected is discarded."""
    none = F.lit(None).cast("string")
    return episodes.filter(F.col("status") == "timeout").select(
        "task_id",
        F.lit("aggregation timeout").alias("reason"),
        iso_utc(as_column(at)).alias("at"),
        none.alias("topic"),
        none.alias("error"),
        none.alias("raw"),
    )


def split_dlq(decoded: DataFrame, topic: str = "topic") -> tuple[DataFrame, DataFrame]:
    """Valid messages, and the dead letters of the others."""
    return decoded.filter("valid").drop("valid", "raw"), malformed_letters(decoded, topic)


def analyzer_type(kind: Column | str, topic: Column | str) -> Column:
    """Analyzer of a result; the last part of the topic name when it does not say."""
    return F.coalesce(
        F.nullif(as_column(kind), F.lit("")), F.element_at(F.split(as_column(topic), r"\."), -1)
    )


def accept_results(valid: DataFrame, topic: str = "topic") -> DataFrame:
    """Flatten `data`, drop results without task id and fill in the analyzer type."""
    others = [c for c in valid.columns if c not in ("data", topic)]
    return (
        flatten(valid, topic, *others)
        .filter(F.coalesce(F.col("task_id"), F.lit("")) != "")
        .withColumn("analyzer_type", analyzer_type("analyzer_type", topic))
        .drop(topic)
    )


def drop_unusable(tasks: DataFrame, counted_as: str = "dropped") -> tuple[DataFrame, Observation]:
    """Skip raw tasks that cannot be scored, counting them on the way.

    Analyzers send no dead letters: a message that is malformed or lacks its task id is
    logged and skipped. The count is available from the observation after the write.
    """
    usable = F.col("valid") & F.col("data.task_id").isNotNull()
    seen = Observation(counted_as)
    kept = (
        tasks.withColumn("_usable", usable)
        .observe(seen, F.count_if(~F.col("_usable")).alias(counted_as))
        .filter("_usable")
    )
    return flatten(kept, *[c for c in tasks.columns if c not in ("data", "raw", "valid")]), seen


def contract_violation() -> Column:
    """Which rule of the result contract a row breaks, NULL when none."""
    return (
        F.when(~F.coalesce(F.col("analyzer_type").isin(schemas.ANALYZERS), F.lit(False)), F.lit("unknown analyzer"))
        .when(~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False)), F.lit("score outside 0..1"))
    )


def check_result(results: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Results to go on with, and violators of the contract.

    The contract is declared but not enforced on the wire, so only `strict` removes rows.
    """
    checked = results.withColumn("violation", contract_violation())
    bad = checked.filter(F.col("violation").isNotNull())
    good = checked.filter(F.col("violation").isNull()) if strict else checked
    return good.drop("violation"), bad


def dedup_messages(results: DataFrame, *scope: str, ts: str = "ts_ms", seq: str = "seq") -> DataFrame:
    """Keep the earliest of identical messages within the scope columns.

    Identical means every field but the arrival stamp, `analyzed_at` included. The minimum
    combines before the shuffle, so a thousand copies leave one row per input partition.
    """
    fields = [c for c in results.columns if c not in (ts, seq)]
    assert set(scope) <= set(fields)
    first = F.min(F.struct(ts, seq)).alias("_first")
    return results.groupBy(*fields).agg(first).select(*fields, f"_first.{ts}", f"_first.{seq}")
