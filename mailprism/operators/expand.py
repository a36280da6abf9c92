"""Corpus augmentation: seed rows, their variants and template rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions.augment import augment_ai, augment_human, template_text
from mailprism.functions.common import unit_hash
from mailprism.operators.corpus import dedup_text, long_enough, seeded_shuffle, trimmed, union_corpora

# Variants per seed row, rows made from templates, seed.
VARIANTS = 30
TEMPLATE_ROWS = 100
SEED = 42

# Bytes of grown text that one task sorts, and buckets of seeds to a task.
TASK_BYTES, TASK_BUCKETS = 32 << 20, 8

_FIELDS = ["text", "label", "source", "ai_assisted"]


def variants(seeds: DataFrame, key: str, seed: int = SEED, per_row: int = VARIANTS) -> DataFrame:
    """Each seed row as it is (variant 0) and `per_row` mutations of it."""
    spread = seeds.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(per_row))))
    keys = [key, "variant"]
    mutated = (
        F.when(F.col("variant") == 0, F.col("text"))
        .when(F.col("ai_assisted") == 1, augment_ai("text", seed, *keys))
        .otherwise(augment_human("text", seed, *keys))
    )
    return spread.withColumn("text", mutated)


def templates(spark: SparkSession, rows: int = TEMPLATE_ROWS, seed: int = SEED) -> DataFrame:
    """Rows made from building blocks only."""
    ai = unit_hash(f"{seed}:t-ai", "id") < 0.5
    spam = unit_hash(f"{seed}:t-spam", "id") < 0.5
    return spark.range(rows).select(
        "id",
        template_text(ai, spam, seed, "id").alias("text"),
        spam.cast("int").alias("label"),
        F.when(ai, "ai").otherwise("human").alias("source"),
        ai.cast("int").alias("ai_assisted"),
    )


def expand_corpus(
    seeds: DataFrame, key: str, seed: int = SEED, per_row: int = VARIANTS, template_rows: int = TEMPLATE_ROWS,
    shuffle: bool = True,
) -> DataFrame:
    """Seeds, variants and templates; short texts dropped, first of equal texts kept.

    The variants are many times the seeds, so the number of tasks follows from the bytes they
    will have. The seeds are dealt out before they grow and copies dropped in each bucket; a
    text is then met once per bucket at most where all are compared.
    """
    tasks = growing_tasks(seeds, per_row)
    bucket = F.pmod(F.xxhash64(key, "text"), F.lit(TASK_BUCKETS * tasks))
    dealt = seeds.withColumn("_bucket", bucket).repartition(tasks, "_bucket")
    order = F.struct(F.lit(0).alias("part"), F.col(key).cast("long").alias("row"), F.col("variant").alias("variant"))
    grown = variants(dealt, key, seed, per_row).select("_bucket", *_FIELDS, order.alias("seq"))
    made = templates(seeds.sparkSession, template_rows, seed).select(
        *_FIELDS, F.struct(F.lit(1).alias("part"), F.col("id").alias("row"), F.lit(0).alias("variant")).alias("seq")
    )
    # Texts are compared without outer white space; the first one is kept as written.
    grown, made = (long_enough(rows).withColumn("_trimmed", trimmed("text")) for rows in (grown, made))
    rows = union_corpora(dedup_text(grown, "_trimmed", "seq", within=("_bucket",)).drop("_bucket"), made)
    first = dedup_text(rows.repartition(tasks, "_trimmed"), "_trimmed", "seq").select(*_FIELDS)
    return seeded_shuffle(first, "text", seed, tasks=tasks) if shuffle else first


def growing_tasks(seeds: DataFrame, per_row: int = VARIANTS) -> int:
    """Tasks for all variants of the seeds, of bounded bytes each; one per core at least."""
    size = seeds.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(seeds.sparkSession.sparkContext.defaultParallelism, -(-size * (per_row + 1) // TASK_BYTES))
