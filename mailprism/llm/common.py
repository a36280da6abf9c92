"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.catalog.frames import prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\x09\x0a\x0b\x0c\x0d\x20"
# Bytes of one Arrow batch, so that a run of very long texts does not fill a Python worker.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers, bound their batches by bytes, free shuffles.

    Operators write what they need again, so the shuffle files of an execution that has
    ended only take disk.
    """
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only a local session may pick one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="mailprism-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: computed once, the same after a lost executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(value: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(value, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; 0 for NULL.

    White space becomes plain spaces, which are trimmed; a word then starts at each end of
    a run of spaces. No array of words is built.
    """
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    single = F.regexp_replace(plain, " {2,}", " ")
    gaps = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", F.lit(0)).otherwise(gaps + 1).cast("long")
