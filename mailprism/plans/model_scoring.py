"""Text scoring with a plugged-in model, keyword scoring without one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions import text as X
from mailprism.functions.common import as_column, round_half_even
from mailprism.functions.subwords import MAX_TOKENS, encoded
from mailprism.functions.vectors import positive_probability

# Called once per Python worker; what it returns gives two logits per text of a batch. It takes
# the texts or, with a vocabulary, their ids and masks, two arrays of texts by window.
Predictor = Callable[[], Callable[..., np.ndarray]]


def model_score(
    clean: Column | str, make_predict: Predictor, batch_size: int = 64, ids: str | None = None, max_tokens: int = MAX_TOKENS
) -> Column:
    """Probability of machine-written text by a plugged-in model, to four digits.

    `ids` is a column of `encoded` texts for a model that takes these.
    """
    logits = T.ArrayType(T.DoubleType())
    if ids is None:
        scored = predict_batch_udf(make_predict, return_type=logits, batch_size=batch_size)(as_column(clean))
    else:
        shapes = [[max_tokens], [max_tokens]]
        predict = predict_batch_udf(make_predict, return_type=logits, batch_size=batch_size, input_tensor_shapes=shapes)
        scored = predict(F.col(f"{ids}.ids"), F.col(f"{ids}.mask"))
    return round_half_even(positive_probability(scored), 4)


def score_text_model(
    df: DataFrame,
    text: str,
    make_predict: Predictor | None = None,
    model_version: str = "model",
    device: str = "cpu",
    batch_size: int = 64,
    vocabulary: Sequence[str] | None = None,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Add `clean_length, score, prediction, reason, model_version, device, model_available`.

    `make_predict` is called once per Python worker and loads the model. What it returns
    gets a batch of whole cleaned texts, which the model cuts to its own window if it has
    one, and gives two logits per text. With a `vocabulary` (see `read_vocabulary`) it gets
    their subword ids and masks instead, cut and padded to `max_tokens`. Without a model the
    keyword score is used.
    `prediction` is 1 from a score of one half on, as `evaluate` takes it.
    """
    cleaned = df.withColumn("_clean", X.clean_text(text))
    if make_predict is None:
        return cleaned.select(
            *df.columns,
            F.length("_clean").alias("clean_length"),
            X.keyword_score("_clean").alias("score"),
            (X.keyword_score("_clean") >= 0.5).cast("int").alias("prediction"),
            F.lit(X.KEYWORD_REASON).alias("reason"),
            F.lit(X.KEYWORD_MODEL).alias("model_version"),
            F.lit("cpu").alias("device"),
            F.lit(False).alias("model_available"),
        )
    pieces = None if vocabulary is None else df.sparkSession.sparkContext.broadcast(list(vocabulary))
    if pieces is not None:
        cleaned = cleaned.withColumn("_encoded", encoded("_clean", pieces, max_tokens))
    scored = cleaned.withColumn("score", model_score("_clean", make_predict, batch_size, "_encoded" if pieces else None, max_tokens))
    decided = (F.col("score") >= 0.5).cast("int")
    return scored.select(
        *df.columns,
        F.length("_clean").alias("clean_length"),
        "score",
        decided.alias("prediction"),
        X.text_reason("score").alias("reason"),
        F.lit(model_version).alias("model_version"),
        F.lit(device).alias("device"),
        F.lit(True).alias("model_available"),
    )


def display(df: DataFrame, text: str, probability: Column | str) -> DataFrame:
    """Label, probability and shortened text, for a quick look."""
    rated = df.withColumn("_p", as_column(probability))
    return rated.select(
        X.display_label("_p").alias("label"),
        round_half_even("_p", 3).alias("probability"),
        X.display_text(text).alias("text"),
    )
