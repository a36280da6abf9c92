"""Verdict table sink, safe to repeat after a failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailprism.operators.verdicts import to_verdict_row

Target = Callable[[DataFrame, int], None]


def parquet_target(path: str) -> Target:
    """Each batch owns one folder and replaces it, so a repeated batch leaves no copies."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


# The table of `jdbc_target`; a database may keep `full_verdict` in a form of its own.
VERDICT_TABLE_DDL = """
CREATE TABLE {table} (
    batch_id BIGINT NOT NULL,
    digest CHAR(64) NOT NULL,
    email_id TEXT NOT NULL,
    overall_risk TEXT,
    ai_assistance_score DOUBLE PRECISION,
    classification TEXT,
    cluster_id TEXT,
    full_verdict JSONB,
    decided_at TIMESTAMP,
    PRIMARY KEY (batch_id, email_id, digest)
)
"""


def with_digest(rows: DataFrame) -> DataFrame:
    """Add the digest of the verdict's text, which no database rewrites as it may the JSON."""
    return rows.withColumn("digest", F.sha2("full_verdict", 256))


def jdbc_target(url: str, table: str, properties: dict[str, str], connections: int = 5) -> Target:
    """Append to a table as in `VERDICT_TABLE_DDL`.

    A write that broke off has left some rows of its batch. Only their keys are read back,
    by the batch id, and rows found among them are not written again.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        query = f"(SELECT email_id AS done_id, digest AS done_digest FROM {table} WHERE batch_id = {int(batch_id)}) AS done"
        done = rows.sparkSession.read.jdbc(url, query, properties=properties)
        fresh = missing(with_digest(rows), done)
        fresh.withColumn("batch_id", F.lit(batch_id)).coalesce(connections).write.mode("append").jdbc(
            url, table, properties={**properties, "stringtype": "unspecified"}
        )

    return write


def missing(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose id and digest are not among the keys that are done."""
    same = (F.col("email_id") == F.col("done_id")) & (F.col("digest") == F.col("done_digest"))
    return rows.join(done, same, "left_anti")


def write_verdicts(verdicts: DataFrame, target: Target, checkpoint: str, every: str = "5 seconds", **trigger) -> StreamingQuery:
    """Stream verdicts into the table; copies of one verdict in a batch are written once."""

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        target(to_verdict_row(batch.dropDuplicates()), batch_id)

    return (
        verdicts.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": every}))
        .start()
    )
