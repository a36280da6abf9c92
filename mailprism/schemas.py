"""Row shapes and names shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# Topic names of the message bus.
EMAILS_RAW = "emails.raw"
EMAILS_PARSED = "emails.parsed"
ANALYSIS_TEXT = "analysis.text"
ANALYSIS_HTML = "analysis.html"
ANALYSIS_IMAGES = "analysis.images"
ANALYSIS_LINKS_META = "analysis.links-meta"
ANALYSIS_AGGREGATED = "analysis.aggregated"
VERDICTS_FINAL = "verdicts.final"
DEAD_LETTER = "dead-letter-queue"
ANALYSIS_TOPICS = [ANALYSIS_TEXT, ANALYSIS_HTML, ANALYSIS_IMAGES, ANALYSIS_LINKS_META]

# Analyzer names, how many of them complete a task, and the clocks.
ANALYZERS = ["text", "html", "images", "links-meta"]
EXPECTED_ANALYZERS = 4
TASK_TIMEOUT_MS = 30_000
SWEEP_MS = 5_000
STATUS_TTL_SECONDS = 3600
SCHEMA_VERSION = "1.0"
MODEL_VERSION = "0.1.0"

RAW_TASK = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("text_part", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("html_part", T.StringType()),
        T.StructField("image_data", T.StringType()),
        T.StructField("image_base64", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)

# `features` differs per analyzer, so on the wire it travels as its JSON text.
RESULT = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("analyzer_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("features", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("analyzed_at", T.StringType()),
    ]
)

RESULT_ITEM = T.StructType([f for f in RESULT.fields if f.name != "task_id"])

AGGREGATE = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("results", T.ArrayType(RESULT_ITEM)),
        T.StructField("aggregated_at", T.StringType()),
    ]
)

VERDICT = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("verdict", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("analyzer_count", T.IntegerType()),
        T.StructField("individual_scores", T.ArrayType(T.DoubleType())),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("decided_at", T.StringType()),
    ]
)

# Nullable union of the two dead-letter shapes (timeout and malformed message).
DEAD_LETTER_ROW = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("raw", T.StringType()),
    ]
)

ATTACHMENT = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)

PARSED_EMAIL = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("from_addr", T.StringType()),
        T.StructField("to_addr", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("text_body", T.StringType()),
        T.StructField("html_body", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("attachments", T.ArrayType(ATTACHMENT)),
        T.StructField("raw_headers", T.MapType(T.StringType(), T.StringType())),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("ai_assisted", T.IntegerType()),
    ]
)
