"""From the results of one task to a verdict and its explanation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, round_half_even

# A mean below the bound gets the verdict; the first match counts.
VERDICT_SCALE = [
    (0.2, "DEFINITELY_HUMAN"),
    (0.4, "PROBABLY_HUMAN"),
    (0.6, "MIXED"),
    (0.8, "PROBABLY_AI"),
    (1.1, "DEFINITELY_AI"),
]
# Wording of the per-analyzer reasons.
REASON_SUSPICIOUS = "обнаружены AI-подобные признаки"
REASON_CLEAN = "признаков AI-генерации нет"


# Scores of this size and above are no scores; sums of smaller ones are exact decimals.
SCORE_LIMIT = 1e9


def countable(score: Column | str) -> Column:
    """The score if it is finite and of usable size, else NULL."""
    value = as_column(score)
    return F.when(~F.isnan(value) & (F.abs(value) < SCORE_LIMIT), value)


def individual_scores(results: Column | str) -> Column:
    """Scores in arrival order; one that is missing or cannot be counted is zero."""
    return F.transform(as_column(results), lambda r: F.coalesce(countable(r["score"]), F.lit(0.0)))


def mean_score(scores: Column | str) -> Column:
    """Mean of an array of doubles, 0.0 when empty, with compensated summation.

    The running error is kept beside the sum, so threshold edges do not depend on the
    order in which the results arrived.
    """
    values = as_column(scores)

    def add(acc: Column, x: Column) -> Column:
        total = acc["hi"] + x
        lost = F.when(F.abs(acc["hi"]) >= F.abs(x), (acc["hi"] - total) + x).otherwise((x - total) + acc["hi"])
        return F.struct(total.alias("hi"), (acc["lo"] + lost).alias("lo"))

    total = F.aggregate(
        values, F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo")), add, lambda acc: acc["hi"] + acc["lo"]
    )
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def verdict(mean: Column | str) -> Column:
    """Five-level verdict of the unrounded mean; NULL from 1.1 on, which no level covers."""
    value = as_column(mean)
    (first_bound, first_name), *others = VERDICT_SCALE
    label = F.when(value < first_bound, first_name)
    for bound, name in others:
        label = label.when(value < bound, name)
    return label


def _score_text(score: Column) -> Column:
    """A double the way the messages print it: plain from 1e-4 on, `1e-05` below.

    Spark's own text turns to exponents below 1e-3, and writes them differently.
    """
    text = score.cast("string")
    size = F.abs(score)
    plain = F.regexp_replace(score.try_cast("decimal(30,24)").cast("string"), "0+$", "")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.lpad(F.substring_index(text, "E-", -1), 2, "0")
    return (
        F.when((size >= 0.001) | (size == 0.0), text)
        .when(size >= 0.0001, plain)
        .otherwise(F.concat(mantissa, F.lit("e-"), exponent))
    )


def explain(results: Column | str) -> Column:
    """One reason per result: its analyzer, whether it is above one half, its score."""

    def one(r: Column) -> Column:
        score = F.coalesce(countable(r["score"]), F.lit(0.0))
        finding = F.when(score > 0.5, F.lit(REASON_SUSPICIOUS)).otherwise(F.lit(REASON_CLEAN))
        return F.concat(
            F.coalesce(r["analyzer_type"], F.lit("?")), F.lit(": "), finding,
            F.lit(" (score="), F.coalesce(_score_text(r["score"]), F.lit("0")), F.lit(")"),
        )

    return F.transform(as_column(results), one)


def rounded_score(mean: Column | str) -> Column:
    return round_half_even(mean, 3)
