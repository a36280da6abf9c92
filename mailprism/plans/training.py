"""Training and evaluation of the baseline text classifier with Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.functions.text import clean_text
from mailprism.operators import corpus as C
from mailprism.operators.metrics import binary_metrics, class_weights, classification_report, roc_auc
from mailprism.operators.terms import MAX_FEATURES, MIN_DF, term_stats
from mailprism.session import cut_lineage
from mailprism.sources import files

TARGET = "ai_assisted"
ROWS_PER_TASK = 5_000


@dataclass(frozen=True)
class BaselineConfig:
    """Settings of the baseline model."""

    target: str = TARGET
    seed: int = 42
    test_size: float = 0.2
    max_features: int = MAX_FEATURES
    min_df: int = MIN_DF
    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4


def clean_corpus(corpus: DataFrame) -> DataFrame:
    """Add `clean` and drop texts that are empty after cleaning."""
    return corpus.withColumn("clean", clean_text("text")).filter(F.length("clean") > 0)


def feature_stages(train: DataFrame, key: str, config: BaselineConfig, n_docs: int) -> list:
    """Stages from cleaned text to a TF-IDF vector of length one.

    The vocabulary has at most `max_features` terms, which bounds what the driver takes in
    and what each stage carries.
    """
    vocabulary = (
        term_stats(train, key, "clean", config.min_df, config.max_features).select("term", "df").collect()
    )
    terms = [row.term for row in vocabulary]
    idf = [math.log((1 + n_docs) / (1 + row.df)) + 1.0 for row in vocabulary]
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="counts")
    return [
        RegexTokenizer(
            inputCol="clean", outputCol="tokens", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}", toLowercase=False
        ),
        NGram(n=2, inputCol="tokens", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(tokens, pairs) AS grams FROM __THIS__"),
        counter,
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
    ]


def train_baseline(train: DataFrame, key: str, path: str, config: BaselineConfig = BaselineConfig()) -> PipelineModel:
    """TF-IDF and L2 logistic regression with balanced class weights, saved below `path`.

    The model is read back from there: a fresh fit holds its training summary, and with it
    the session, which cannot be sent to executors once a query has been observed.

    The penalty of weight 1/C on a sum of losses becomes 1/(C * sum of weights) on Spark's
    mean loss, and balanced weights sum to the number of rows.
    """
    features, vectors, n_docs = _weighted_vectors(train, key, config)
    # The fit blocks and caches its input itself, so a second copy is not kept here.
    model = _regression(config, 1.0 / (config.c * n_docs)).fit(vectors)
    files.save_model(PipelineModel(stages=[*features.stages, model]), path)
    return files.load_model(path)


def _weighted_vectors(train: DataFrame, key: str, config: BaselineConfig) -> tuple[PipelineModel, DataFrame, int]:
    """Fitted feature stages, the frame (features, label, weight) and its number of rows."""
    C.assert_trainable(train, config.target)
    weights = class_weights(train.select(F.col(config.target).alias("label"))).collect()  # one row per class
    n_docs = sum(row.n for row in weights)
    lookup = F.create_map(*[F.lit(v) for row in weights for v in (float(row.label), float(row.weight))])
    label = F.col(config.target).cast("double")
    features = Pipeline(stages=feature_stages(train, key, config, n_docs)).fit(train)
    rows = train.select(key, "clean", label.alias("label"), lookup[label].alias("weight"))
    # Written first, so that all cores make the features.
    vectors = cut_lineage(features.transform(rows).select(key, "features", "label", "weight"))
    # Each iteration is a job; few rows are not worth many tasks. No change for large data.
    return features, vectors.coalesce(n_docs // ROWS_PER_TASK + 1), n_docs


def _regression(config: BaselineConfig, penalty: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", regParam=penalty, elasticNetParam=0.0,
        standardization=False, maxIter=config.max_iter, tol=config.tol,
    )


def predict(model: PipelineModel, cleaned: DataFrame) -> DataFrame:
    """Add `prediction` and `probability` of class 1; intermediate vectors are dropped."""
    scored = model.transform(cleaned)
    return scored.select(
        *cleaned.columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
    )


def evaluate(predictions: DataFrame, label: str) -> DataFrame:
    """One row: n, accuracy, precision, recall, f1 and roc_auc (NULL for a single class)."""
    rates = binary_metrics(predictions, label, "prediction")
    area = roc_auc(predictions, label, "probability")
    # Both frames are single rows, joined on a constant.
    return rates.withColumn("_one", F.lit(1)).join(area.withColumn("_one", F.lit(1)), "_one").drop("_one")


def select_regularisation(
    train: DataFrame, key: str, candidates: list[float], path: str, config: BaselineConfig = BaselineConfig(),
    held_out: float = 0.2,
) -> float:
    """C with the best F1 on a validation split, the role of keeping the best epoch.

    Vectors are made once; the models of the candidates are saved below `path`.
    """
    _, vectors, n_docs = _weighted_vectors(train, key, config)
    parts = cut_lineage(
        C.stratified_split(vectors, "label", key, {"fit": 1 - held_out, "check": held_out}, config.seed)
    )
    scores = []
    for place, c in enumerate(candidates):
        model = _regression(config, 1.0 / (c * n_docs)).fit(parts.filter(F.col("split") == "fit"))
        model.write().overwrite().save(f"{path}/candidate-{place}")
        fitted = LogisticRegressionModel.load(f"{path}/candidate-{place}")
        checked = fitted.transform(parts.filter(F.col("split") == "check"))
        scores.append(binary_metrics(checked, "label", "prediction").first().f1)
    return candidates[max(range(len(candidates)), key=scores.__getitem__)]


@dataclass
class TrainingRun:
    model: PipelineModel
    summary: DataFrame
    metrics: DataFrame
    report: DataFrame


def run_training(
    spark: SparkSession, corpora: list[DataFrame], out: str, config: BaselineConfig = BaselineConfig()
) -> TrainingRun:
    """Union, clean, split, train, evaluate; writes corpus, test split, model and metrics.

    The cleaned corpus is written first and read back, so cleaning runs once and every
    later stage starts from files.
    """
    corpus = C.union_corpora(*corpora)
    files.write_parquet(clean_corpus(corpus), f"{out}/combined_clean.parquet")
    cleaned = files.read_parquet(spark, f"{out}/combined_clean.parquet").withColumn(
        "row_id", F.sha2(F.concat_ws("|", "source", "label", "text"), 256)
    )
    C.assert_trainable(cleaned, config.target)
    parts = C.stratified_split(
        cleaned, config.target, "row_id", {"train": 1 - config.test_size, "test": config.test_size}, config.seed
    )
    train = parts.filter(F.col("split") == "train")
    test = parts.filter(F.col("split") == "test")
    files.write_parquet(test.select(F.col("clean").alias("text"), F.col(config.target).alias("label")), f"{out}/baseline_test.parquet")
    model = train_baseline(train, "row_id", f"{out}/baseline_model", config)
    predictions = cut_lineage(predict(model, test.select("clean", config.target)))
    metrics = evaluate(predictions, config.target)
    files.write_metrics(metrics.select("accuracy", "roc_auc"), f"{out}/baseline_metrics.json")
    report = classification_report(predictions, config.target, "prediction")
    return TrainingRun(model, C.corpus_summary(cleaned), metrics, report)
