"""Exact ranks without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_in_slots(
    df: DataFrame, group: list[str], slot: Column, order: list[str], name: str, size: str | None = None
) -> DataFrame:
    """Add the one-based rank of a row in its group as column `name`, its size as `size`.

    `slot` must rise with `order`. Rows are ranked inside (group, slot) and shifted by the
    counts of the slots before; the windows over a whole group run on those counts only.
    """
    slotted = df.withColumn("_slot", slot)
    keys = [*group, "_slot"]
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_size", F.sum("_n").over(Window.partitionBy(*group)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    offsets = offsets.select(*(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)), "_before", "_size")
    same = F.lit(True)
    for i, key in enumerate(keys):  # NULL is a key like any other
        same = same & F.col(key).eqNullSafe(F.col(f"_of{i}"))
    ranked = slotted.join(offsets, same).withColumn(name, F.col("_before") + F.row_number().over(inside))
    if size is not None:
        ranked = ranked.withColumn(size, F.col("_size"))
    return ranked.drop("_slot", "_before", "_size", *(f"_of{i}" for i in range(len(keys))))
