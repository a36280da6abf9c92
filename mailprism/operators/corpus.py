"""Labelled corpora: union, labels from folders, de-duplication, counts, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, unit_hash
from mailprism.operators.ranking import ranked_in_slots

# Augmented texts at most this long are dropped.
SHORT_TEXT = 15


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """All corpora as one frame; an empty one adds nothing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), corpora)


def folder_label(path: Column | str) -> Column:
    """1 for a parent folder with "spam" in its name, 0 for "ham", else NULL."""
    folder = F.lower(F.regexp_extract(as_column(path), r"([^/]+)/[^/]+$", 1))
    return F.when(F.contains(folder, F.lit("spam")), 1).when(F.contains(folder, F.lit("ham")), 0)


def label_from_path(files: DataFrame, path: str = "path") -> DataFrame:
    """Keep files in spam or ham folders; mail from disk counts as written by people."""
    return (
        files.withColumn("label", folder_label(path))
        .filter(F.col("label").isNotNull())
        .withColumn("source", F.lit("human"))
        .withColumn("ai_assisted", F.lit(0))
    )


def trimmed(text: Column | str) -> Column:
    """Text without white space at either end, line breaks included."""
    return F.regexp_replace(as_column(text), r"(?U)^\s++|(?<!\s)\s++$", "")


def nonblank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.rlike(text, F.lit(r"(?U)\S")))


def long_enough(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.length(trimmed(text)) > SHORT_TEXT)


def dedup_text(df: DataFrame, text: str = "text", order: str = "seq", within: tuple[str, ...] = ()) -> DataFrame:
    """One row per text, or per text and the columns `within`, the one with the smallest `order`.

    A minimum, not a row number: the copies of a text are reduced before the shuffle, so a
    text that makes up a third of the corpus does not land in one task.
    """
    keys = [*within, text]
    others = [c for c in df.columns if c not in (*keys, order)]
    first = F.min(F.struct(order, *others)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """One row: total, spam, ham, machine-assisted, human."""
    return corpus.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label") == 1).alias("spam"),
        F.count_if(F.col("label") == 0).alias("ham"),
        F.count_if(F.col("ai_assisted") == 1).alias("ai_assisted"),
        F.count_if(F.col("ai_assisted") == 0).alias("human"),
    )


def assert_trainable(corpus: DataFrame, target: str) -> None:
    """Raise unless the target column is there and holds two classes or more."""
    if target not in corpus.columns:
        raise ValueError(f"Target column '{target}' not found in data.")
    if len(corpus.select(target).filter(F.col(target).isNotNull()).distinct().limit(2).collect()) < 2:
        raise ValueError(f"Target '{target}' has only one class — need both AI and human samples.")


def stratified_split(
    df: DataFrame,
    label: str,
    key: str,
    parts: dict[str, float],
    seed: int = 42,
    exact: bool = False,
    slots: int = 4096,
) -> DataFrame:
    """Add `split`, the name of the part a row belongs to; shares are given in order.

    By default a row's seeded hash is compared with the cut points: no shuffle, and the
    shares hold per label in expectation. `exact` makes them hold to the row: hashes are
    ranked per label inside slots of the hash range, so a label with most of the rows is
    ranked by as many tasks as there are slots. `key` is unique.
    """
    names = list(parts)
    bounds, total = [], 0.0
    for name in names[:-1]:
        total += parts[name]
        bounds.append(total)
    hashed = df.withColumn("_u", unit_hash(seed, key))

    def cut(value: Column, limits: list[Column]) -> Column:
        chosen = F.lit(names[-1])
        for name, limit in reversed(list(zip(names, limits))):
            chosen = F.when(value < limit, F.lit(name)).otherwise(chosen)
        return chosen

    if not exact:
        return hashed.withColumn("split", cut(F.col("_u"), [F.lit(b) for b in bounds])).drop("_u")
    ranked = ranked_in_slots(hashed, [label], F.floor(F.col("_u") * slots), ["_u", key], "_rank", "_total")
    limits = [F.floor(F.col("_total") * b + 0.5) for b in bounds]
    return ranked.withColumn("split", cut(F.col("_rank") - 1, limits)).select(*df.columns, "split")


def seeded_shuffle(df: DataFrame, text: str = "text", seed: int = 42, key: str | None = None, tasks: int | None = None) -> DataFrame:
    """Rows in an order that depends on the seed and the text only; equal texts go by `key`.

    A unique `key` also lets the sort deal the copies of one text to several tasks. `tasks` is
    how many sort, if not as many as the session's shuffles have.
    """
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.col(text))), *([F.col(key)] if key else [])]
    return df.orderBy(*order) if tasks is None else df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
