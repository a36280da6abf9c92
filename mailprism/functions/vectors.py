"""Softmax and argmax over array columns of logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, let


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits, shifted by the largest before `exp`."""
    values = F.transform(as_column(logits), lambda x: x.cast("double"))

    def weights_of(v: Column) -> Column:
        return let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    def shares(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(weights, lambda w: w / t))

    return let(let(values, weights_of), shares)


def argmax(values: Column | str) -> Column:
    """Zero-based place of the first largest element."""
    array = as_column(values)
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def positive_probability(logits: Column | str) -> Column:
    """Softmax probability of class 1."""
    return F.element_at(softmax(logits), 2)
