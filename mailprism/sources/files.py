"""Files: mail trees, labelled CSV, Parquet, metrics and models."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.operators.corpus import label_from_path, nonblank
from mailprism.operators.email_job import parse_emails
from mailprism.functions.text import strip_html

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"'}


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_mail_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below the folder: `path` and `raw`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("content").alias("raw"))


def read_eml_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled corpus from a tree of mail files in spam and ham folders.

    The label filter looks at the path only, so other files are dropped before parsing.
    A message without text falls back to its HTML reduced to text.
    """
    labelled = label_from_path(read_mail_files(spark, folder))
    parsed = parse_emails(labelled, "raw", keep=["label", "source", "ai_assisted"])
    text = F.when(F.col("text_body") != "", F.col("text_body")).otherwise(strip_html("html_body"))
    return nonblank(parsed.select(text.alias("text"), "label", "source", "ai_assisted"))


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV with header; a missing file gives an empty frame and a warning."""
    try:
        return spark.read.schema(schemas.CORPUS).options(**CSV_OPTIONS).csv(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        warnings.warn(f"{path} not found", stacklevel=2)
        return spark.createDataFrame([], schemas.CORPUS)


def write_labeled_csv(corpus: DataFrame, path: str) -> None:
    """CSV with header, every value quoted."""
    corpus.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet input; says what is missing when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"{path} not found: run the training flow first") from error
        raise


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics frame as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
