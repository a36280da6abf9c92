"""The supplied tables in the roles the operators need."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism.session import spread

_SHIPPED: set[str] = set()

# Bytes that cross to Python together.
BATCH_BYTES = 8 << 20

# Phrases appended to documents, so that keyword scores differ between rows.
PHRASES = [
    "Please verify your account immediately.",
    "URGENT: confirm your password, verify the account.",
    "Ваш аккаунт будет заблокирован, срочно подтвердите пароль!",
    "See https://example.com/a?b=1 or write to joe.doe@mail.example.org now.",
]


def prepare(spark: SparkSession) -> None:
    """Fix the session time zone and the size of batches, and make the package known to the Python workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Rows are whole texts, so a Python worker takes them by bytes and not by their number.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="mailprism-dist-")
    context.addPyFile(shutil.make_archive(f"{folder}/mailprism", "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)


_TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "events": "event_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose text is worked on row by row, spread when it is one small file."""
    return spread(table(spark, folder, name), _TEXT_KEYS[name])


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def phrased_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a phrase of `PHRASES` behind the text, two rows in six without."""
    return text_table(spark, folder, "documents").select("doc_id", "lang", "source", phrased_text().alias("text"))


def phrased_text() -> Column:
    """`text` with the phrase that `doc_id` picks, if it picks one."""
    turn = F.pmod(F.col("doc_id"), F.lit(6))
    phrase = F.lit("")
    for i, text in enumerate(PHRASES):
        phrase = F.when(turn == i, F.lit(" " + text)).otherwise(phrase)
    return F.concat("text", phrase)


def analyzer_name(event_type: Column | str) -> Column:
    value = F.col(event_type) if isinstance(event_type, str) else event_type
    return (
        F.when(value == "click", "text").when(value == "view", "html").when(value == "purchase", "images")
        .when(value == "signup", "links-meta").otherwise(value)
    )


def event_results(spark: SparkSession, folder: str, per_day: bool = True) -> DataFrame:
    """Events as analyzer results; a task is a user's day, or a user."""
    events = table(spark, folder, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    user = F.col("user_id").cast("string")
    return events.select(
        (F.concat(user, F.lit("-"), day) if per_day else user).alias("task_id"),
        analyzer_name("event_type").alias("analyzer_type"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("score"),
        F.col("props").alias("features"),
        F.col("event_type").alias("reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("analyzed_at"),
        epoch_ms("ts").alias("ts_ms"),
        F.col("event_id").alias("seq"),
    )


def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as bus messages: JSON values, some malformed, some without id or type."""
    events = text_table(spark, folder, "events")
    turn = F.pmod(F.col("event_id"), F.lit(97))
    task = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    kind = analyzer_name("event_type")
    fields = F.concat(
        F.lit('{"task_id": "'), F.when(turn == 5, F.lit("")).otherwise(task),
        F.lit('", '), F.when(turn == 7, F.lit("")).otherwise(F.concat(F.lit('"analyzer_type": "'), kind, F.lit('", '))),
        F.lit('"score": '), (F.least(F.col("value") / 100, F.lit(1.0))).cast("decimal(10,4)").cast("string"),
        F.lit(', "features": '), F.col("props"), F.lit("}"),
    )
    value = F.when(turn == 0, F.lit("{bad")).when(turn == 1, F.lit("[1]")).when(
        turn == 2, F.concat(fields, F.lit(" trailing"))
    ).otherwise(fields)
    return events.select(
        F.col("event_id").alias("seq"),
        value.cast("binary").alias("value"),
        F.concat(F.lit("analysis."), kind).alias("topic"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def linked_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with absolute links; every third has an anchor that names another host."""
    pages = text_table(spark, folder, "pages")
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    absolute = F.replace("html", F.lit('href="/'), F.concat(F.lit('href="https://'), host, F.lit("/")))
    lure = F.when(
        F.pmod(F.col("page_id"), F.lit(3)) == 0,
        F.concat(F.lit('<a class="p-4 text-sm" href="'), F.col("url"), F.lit('">www.bank.example.com</a><form style="display:none"></form>')),
    ).otherwise(F.lit(""))
    return pages.select(
        F.col("page_id").cast("string").alias("task_id"), "page_id", "url", F.concat(absolute, lure).alias("html")
    )


def suspicious_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts of the pages whose name speaks of bets, casinos or spam."""
    host = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)
    hosts = table(spark, folder, "pages").select(F.regexp_replace(host, r"^www\.", "").alias("domain"))
    return hosts.filter(F.col("domain").rlike("bets|casino|spam")).distinct()


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry labels; low quality plays the machine-written class."""
    documents = text_table(spark, folder, "documents").select("doc_id", "text", "source")
    labels = table(spark, folder, "labels")
    return documents.join(labels, "doc_id").select(
        "doc_id", "text", F.col("toxic").alias("label"), "source", (1 - F.col("quality")).alias("ai_assisted")
    )


def conversation_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as a corpus: those of the assistant are machine-written."""
    turns = text_table(spark, folder, "conversations")
    ai = (F.col("role") == "assistant").cast("int")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        "text",
        F.lit(0).alias("label"),
        F.when(ai == 1, "ai").otherwise("human").alias("source"),
        ai.alias("ai_assisted"),
    )


def raw_mail(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as MIME mail: base64 text part with a link, HTML part, attachment."""
    documents = text_table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    body = F.concat(F.col("text"), F.lit("\nhttp://example.com/"), key)
    html = F.concat(F.lit('<p><a href="https://example.org/'), key, F.lit('">x</a></p>'))

    def encoded(text: Column) -> Column:
        return F.base64(F.encode(text, "UTF-8"))

    lines = [
        F.concat(F.lit("From: sender"), key, F.lit("@example.com")),
        F.lit("To: box@example.org"),
        F.concat(F.lit("Subject: =?UTF-8?B?"), encoded(F.concat(F.lit("Тема "), key)), F.lit("?=")),
        F.concat(F.lit("Message-ID: <"), key, F.lit("@example.com>")),
        F.lit("MIME-Version: 1.0"),
        F.lit('Content-Type: multipart/mixed; boundary="cut"'),
        F.lit(""),
        F.lit("--cut"),
        F.lit("Content-Type: text/plain; charset=utf-8"),
        F.lit("Content-Transfer-Encoding: base64"),
        F.lit(""),
        encoded(body),
        F.lit("--cut"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.lit(""),
        html,
        F.lit("--cut"),
        F.lit('Content-Type: application/octet-stream; name="data.bin"'),
        F.lit('Content-Disposition: attachment; filename="data.bin"'),
        F.lit("Content-Transfer-Encoding: base64"),
        F.lit(""),
        encoded(F.col("source")),
        F.lit("--cut--"),
        F.lit(""),
    ]
    return documents.select("doc_id", F.encode(F.concat_ws("\n", *lines), "UTF-8").alias("raw"))
