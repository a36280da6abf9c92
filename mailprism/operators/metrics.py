"""Classifier metrics as DataFrame aggregates."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is empty."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall and F1 of class 1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("hits"),
        F.count_if(y & p).alias("tp"),
        F.count_if(p).alias("predicted"),
        F.count_if(y).alias("actual"),
    )
    rated = counts.select(
        "n",
        _ratio(F.col("hits"), F.col("n")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"),
    )
    return rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", slots: int = 256) -> DataFrame:
    """One row `roc_auc`: chance that a positive outranks a negative, ties count half.

    NULL when only one class is present. Rows collapse to counts per distinct score first.
    These are cut at approximate quantiles into slots of like size, the negatives of the
    slots before are added as an offset, and running sums stay inside a slot.
    """
    counts = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    shares = [i / slots for i in range(1, slots)]
    cuts = sorted(set(counts.stat.approxQuantile("score", shares, 0.25 / slots)))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        placed = Bucketizer(splits=splits, inputCol="score", outputCol="slot").transform(counts)
    else:
        placed = counts.withColumn("slot", F.lit(0.0))
    # At most `slots` rows, so the window over all of them is small.
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("slot").agg(F.sum("neg").alias("slot_neg"))
    offsets = totals.select("slot", F.coalesce(F.sum("slot_neg").over(before), F.lit(0)).alias("neg_slots"))
    inside = Window.partitionBy("slot").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("neg_slots") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    summed = (
        placed.join(F.broadcast(offsets), "slot")
        .select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won"))
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    pairs = F.col("pos").cast("double") * F.col("neg")
    return summed.select(F.when(pairs > 0, F.col("won") / pairs).alias("roc_auc"))


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(
        F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")
    ).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per class, then `accuracy`, `macro avg` and `weighted avg`.

    The data is read once into the confusion counts; the rest works on these few rows.
    """
    cells = confusion_counts(df, label, prediction)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        )
    )
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    rated = sums.withColumn("precision", _ratio(F.col("hits"), F.col("predicted"))).withColumn(
        "recall", _ratio(F.col("hits"), F.col("support"))
    )
    classes = rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    weighted = {m: F.sum(F.col(m) * F.col("support")) / F.sum("support") for m in ("precision", "recall", "f1")}
    accuracy = F.sum("hits") / F.sum("support")
    summary = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"),
                accuracy.alias("f1"), F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"), weighted["precision"].alias("precision"),
                weighted["recall"].alias("recall"), weighted["f1"].alias("f1"), F.sum("support").alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    per_class = classes.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    return per_class.unionByName(summary)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) of each class; one row per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    # The list holds one entry per class.
    whole = counts.agg(F.collect_list(F.struct("label", "n")).alias("classes"), F.sum("n").alias("total"))
    return whole.select(F.explode("classes").alias("c"), F.size("classes").alias("k"), "total").select(
        F.col("c.label").alias("label"),
        F.col("c.n").alias("n"),
        (F.col("total") / (F.col("k") * F.col("c.n"))).alias("weight"),
    )
