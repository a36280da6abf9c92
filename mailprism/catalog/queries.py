"""Spark queries by name; each takes the session and the folder of the tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailprism import schemas
from mailprism.catalog import frames as D
from mailprism.functions import html as H
from mailprism.functions import image as I
from mailprism.functions import links as L
from mailprism.functions import subwords
from mailprism.functions import text as X
from mailprism.functions import vectors
from mailprism.functions import verdict as V
from mailprism.functions.augment import fill
from mailprism.functions.common import first_nonempty, round_half_even
from mailprism.operators import campaigns as G
from mailprism.operators import corpus as C
from mailprism.operators import correlate as J
from mailprism.operators import email_job as E
from mailprism.operators import intake, metrics, terms
from mailprism.operators import results as R
from mailprism.operators import verdicts as W
from mailprism.operators.episodes import EpisodeRules, replay_aggregation
from mailprism.operators.expand import expand_corpus
from mailprism.operators.ranking import ranked_in_slots
from mailprism.operators.similar import CampaignStore
from mailprism.plans import scoring, training
from mailprism.plans.model_scoring import display, score_text_model
from mailprism.session import cut_lineage
from mailprism.streaming import flow
from mailprism.streaming.aggregate import aggregate_stream
from mailprism.streaming.status import current_status, status_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY_MS = 86_400_000
REPLAY = EpisodeRules(timeout_ms=3 * DAY_MS, sweep_ms=DAY_MS // 4)


def _moment() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        D.prepare(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


def _decimal_text(value: Column) -> Column:
    return value.cast("decimal(10,4)").cast("string")


# --- intake and text -----------------------------------------------------------------


@query
def intake_validation(spark, folder):
    documents = D.table(spark, folder, "documents")
    return documents.select(
        "doc_id", intake.intake_rejection("text").isNull().alias("accepted"), intake.intake_rejection("text").alias("rejection")
    )


@query
def task_stamping(spark, folder):
    accepted, _ = intake.validate_intake(D.table(spark, folder, "documents"))
    stamped = intake.stamp_tasks(accepted, "doc_id", "source", created_at=_moment())
    return stamped.select("doc_id", "task_id", "created_at")


@query
def clean_text(spark, folder):
    return D.phrased_documents(spark, folder).select("doc_id", X.clean_text("text").alias("clean"))


@query
def keyword_scoring(spark, folder):
    cleaned = D.phrased_documents(spark, folder).select("doc_id", X.clean_text("text").alias("clean"))
    return cleaned.select(
        "doc_id", X.keyword_hits("clean").alias("hits"), X.keyword_score("clean").alias("score"),
        F.length("clean").alias("clean_length"),
    )


@query
def first_nonempty_choice(spark, folder):
    documents = D.table(spark, folder, "documents")
    text = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("text"))
    part = F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("source"))
    return documents.select("doc_id", F.md5(first_nonempty(text, part)).alias("chosen"))


@query
def nonblank_filter(spark, folder):
    documents = D.table(spark, folder, "documents")
    blanked = documents.select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit(" \n\t ")).otherwise(F.col("text")).alias("text"))
    return C.nonblank(blanked).select("doc_id")


@query
def short_text_filter(spark, folder):
    """Whole turns, and documents under negative ids, with white space around."""
    turns = D.conversation_corpus(spark, folder).select("doc_id", "text")
    documents = D.table(spark, folder, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    padded = turns.unionByName(documents).withColumn("text", F.concat(F.lit("  "), "text", F.lit(" ")))
    return C.long_enough(padded).select("doc_id")


@query
def word_ngrams(spark, folder):
    grams = D.text_table(spark, folder, "documents").select("doc_id", X.word_ngrams(X.word_tokens(F.lower("text"))).alias("g"))
    return grams.select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("digest"))


def _cleaned(spark, folder) -> DataFrame:
    """Cleaned documents, written: the vocabulary reads them twice."""
    return cut_lineage(D.text_table(spark, folder, "documents").select("doc_id", X.clean_text("text").alias("clean")))


@query
def term_statistics(spark, folder):
    return terms.term_stats(_cleaned(spark, folder), "doc_id", "clean")


@query
def tfidf_weights(spark, folder):
    documents = _cleaned(spark, folder)
    vocabulary = terms.term_stats(documents, "doc_id", "clean")
    weights = terms.tfidf(documents, "doc_id", "clean", vocabulary, documents.count())
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _stand_in_model():
    """A model whose second logit is the text length over a thousand."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[0.0, len(t) / 1000.0] for t in texts])

    return predict


def _vocabulary(cleaned: DataFrame) -> list[str]:
    """Subwords of the documents: specials, letters, frequent words and frequent ends of words, in order.

    Letters are those of the alphabets in use; words and ends are cut by their counts, which
    rise with the documents, and by the encoder's bound.
    """
    parts = cleaned.select(F.explode(F.regexp_extract_all("clean", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).alias("w"))
    counted = cut_lineage(parts.groupBy("w").agg(F.count("*").alias("n")))  # read three times
    letters = counted.select(F.explode(F.split("w", "")).alias("c")).filter("c <> ''").distinct()
    words = counted.filter((F.col("n") >= 20) & (F.length("w") > 1)).select(F.col("w").alias("p"))
    ends = counted.filter(F.length("w") > 3).groupBy(F.right("w", F.lit(3)).alias("p")).agg(F.sum("n").alias("n"))
    ends = ends.filter(F.col("n") >= 50).select(F.concat(F.lit(subwords.INSIDE), "p"))
    pieces = letters.unionByName(letters.select(F.concat(F.lit(subwords.INSIDE), "c").alias("c"))).union(words).union(ends).distinct()
    specials = [subwords.PAD, subwords.UNKNOWN, subwords.FIRST, subwords.LAST]
    return specials + [r.c for r in pieces.orderBy("c").limit(subwords.MAX_PIECES).collect()]


@query
def text_encoding(spark, folder):
    """Subword ids of the documents in a window of 256, with how many of them are text."""
    cleaned = _cleaned(spark, folder)
    pieces = spark.sparkContext.broadcast(_vocabulary(cleaned))
    ids = cleaned.select("doc_id", subwords.encoded("clean", pieces).alias("e"))
    return ids.select(
        "doc_id", F.size("e.ids").alias("n_ids"), F.aggregate("e.mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        F.md5(F.array_join("e.ids", ",")).alias("digest"),
    )


def _stand_in_id_model():
    """A model of ids: its second logit rises with the text's mean id."""

    def predict(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        mean = (ids.astype(np.int64) * mask).sum(axis=1) / mask.sum(axis=1)
        return np.stack([np.zeros(len(ids)), mean / 1000.0], axis=1)

    return predict


@query
def text_model_scoring(spark, folder):
    documents = D.text_table(spark, folder, "documents").select("doc_id", "text")
    scored = score_text_model(documents, "text", _stand_in_id_model, "stand-in", vocabulary=_vocabulary(_cleaned(spark, folder)))
    return scored.drop("text", "device")


@query
def text_model_fallback(spark, folder):
    documents = D.phrased_documents(spark, folder).select("doc_id", "text")
    return score_text_model(documents, "text").drop("text", "device")


@query
def display_rows(spark, folder):
    turns = D.table(spark, folder, "conversations")
    shown = display(turns, "text", F.col("turn") / (F.col("turn") + 3))
    return shown.groupBy("label", "probability", "text").agg(F.count("*").alias("n"))


# --- HTML, links, images --------------------------------------------------------------


@query
def strip_html(spark, folder):
    return D.text_table(spark, folder, "pages").select("page_id", X.strip_html("html").alias("text"))


@query
def html_features(spark, folder):
    pages = D.linked_pages(spark, folder).select("page_id", "html")
    return H.with_html_features(pages, "html").drop("html")


@query
def html_scoring(spark, folder):
    pages = D.linked_pages(spark, folder).select("page_id", "html")
    counted = H.with_html_features(pages, "html")
    return counted.select("page_id", H.html_score().alias("score"), H.html_reason().alias("reason"))


@query
def link_extraction(spark, folder):
    pages = D.linked_pages(spark, folder).withColumn("text", F.concat(F.lit("see "), F.col("url"), F.lit(" now")))
    return L.explode_links(pages, "page_id", "html", "text")


@query
def link_scoring(spark, folder):
    pages = D.linked_pages(spark, folder)
    scored = scoring.score_links(pages, D.suspicious_domains(spark, folder), _moment())
    return scored.select("task_id", "score", "reason")


@query
def image_payloads(spark, folder):
    documents = D.text_table(spark, folder, "documents")
    encoded = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    none = F.pmod("doc_id", F.lit(5)) == 0
    payload = I.decode_image_payload(F.when(~none, encoded), F.lit(None).cast("string"))
    decoded = documents.select("doc_id", payload.alias("payload"))
    return decoded.select("doc_id", F.octet_length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))


def _png(spark, folder) -> DataFrame:
    documents = D.table(spark, folder, "documents")
    turn = F.pmod("doc_id", F.lit(4))
    size = F.lpad(F.hex("n_chars"), 8, "0")
    header = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(F.col("doc_id") + 1), 8, "0"), size, F.lit("0806000000"), F.lit("00000000"))
    note = F.lit("0000000774455874") # a tEXt chunk of seven bytes
    text = F.concat(note, F.hex(F.encode(F.lit("Author"), "UTF-8")), F.lit("00"), F.lit("00000000"))
    data = (
        F.when(turn == 0, F.lit("")).when(turn == 1, F.lit("FFFF")).when(turn == 2, header).otherwise(F.concat(header, text))
    )
    codes = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit("qr"))).otherwise(F.array().cast("array<string>"))
    return documents.select("doc_id", F.unhex(data).alias("image"), codes.alias("qr_codes"))


@query
def image_headers(spark, folder):
    return _png(spark, folder).select("doc_id", I.image_header("image").alias("h")).select(
        "doc_id", "h.format", "h.width", "h.height"
    )


@query
def image_scoring(spark, folder):
    facts = I.with_image_facts(_png(spark, folder), "image")
    return facts.select(
        "doc_id",
        "format",
        F.coalesce(F.array_join("metadata_keys", "|"), F.lit("")).alias("keys"),
        I.image_score("n_bytes", "decode_error", "metadata_keys", "qr_codes").alias("score"),
        I.image_reason("n_bytes", "decode_error", "qr_codes").alias("reason"),
    )


def _images(spark, folder) -> DataFrame:
    """Images of six formats with sizes from the rows: headers, and a directory for TIFF."""
    documents = D.table(spark, folder, "documents")
    width, height = F.pmod("doc_id", F.lit(16_000)) + 1, F.pmod("n_chars", F.lit(16_000)) + 1

    def big(value: Column, size: int) -> Column:
        return F.lpad(F.hex(value), 2 * size, "0")

    def little(value: Column, size: int) -> Column:
        digits = big(value, size)
        return F.concat(*[F.substring(digits, at, 2) for at in range(2 * size - 1, 0, -2)])

    def tiff(number, start: str) -> Column:
        def entry(tag: int, kind: int, value: Column) -> Column:
            # Short values fill the first half of the four bytes.
            body = F.concat(number(value, 2), F.lit("0000")) if kind == 3 else number(value, 4)
            return F.concat(number(F.lit(tag), 2), number(F.lit(kind), 2), number(F.lit(1), 4), body)

        entries = [entry(256, 4, width), entry(257, 3, height), entry(258, 3, F.lit(8)), entry(262, 3, F.lit(1)), entry(34675, 4, F.lit(8))]
        # The directory lies behind four bytes that belong to nothing.
        return F.concat(F.lit(start), number(F.lit(12), 4), F.lit("FFFFFFFF"), number(F.lit(len(entries)), 2), *entries, F.lit("00000000"))

    packed = (width - 1) + (height - 1) * 16384 + 2**28
    kinds = [
        F.concat(F.lit("474946383961"), little(width, 2), little(height, 2), F.lit("800000")),
        F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(width, 4), little(F.lit(2**32) - height, 4), F.lit("01001800" + "00" * 24)),
        F.concat(F.lit("52494646" + "00" * 4 + "5745425056503820" + "00" * 7 + "9D012A"), little(width, 2), little(height, 2)),
        F.concat(F.lit("52494646" + "00" * 4 + "574542505650384C" + "00" * 4 + "2F"), little(packed, 4)),
        F.concat(F.lit("52494646" + "00" * 4 + "5745425056503858" + "00" * 4 + "2C000000"), little(width - 1, 3), little(height - 1, 3)),
        tiff(little, "49492A00"),
        tiff(big, "4D4D002A"),
        F.concat(F.lit("FFD8FFFE0004" + "6869" + "FFC0001108"), big(height, 2), big(width, 2), F.lit("03" + "00" * 9)),
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(width, 4), big(height, 4), F.lit("1002000000" + "00" * 4)),
        F.lit("49492A00FFFFFF7F"),
    ]
    return documents.select("doc_id", F.unhex(F.get(F.array(*kinds), F.pmod("doc_id", F.lit(len(kinds))).cast("int"))).alias("image"))


@query
def image_formats(spark, folder):
    facts = I.with_image_facts(_images(spark, folder), "image")
    return facts.select("doc_id", "format", "width", "height", "mode", F.array_join("metadata_keys", "|").alias("keys"), "decode_error")


# --- mail -----------------------------------------------------------------------------


@query
def mail_parsing(spark, folder):
    parsed = E.parse_emails(D.raw_mail(spark, folder))
    return parsed.select(
        "doc_id", "subject", "from_addr", "to_addr", "message_id", F.md5("text_body").alias("text_digest"), "html_body",
        F.size("links").alias("n_links"), F.size("attachments").alias("n_attachments"),
        F.element_at("raw_headers", "From").alias("from_header"),
    )


@query
def mail_links(spark, folder):
    return E.email_links(E.parse_emails(D.raw_mail(spark, folder)), "doc_id")


@query
def mail_attachments(spark, folder):
    return E.email_attachments(E.parse_emails(D.raw_mail(spark, folder)), "doc_id")


@query
def attachment_facts(spark, folder):
    documents = D.table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    return E.attachment_facts(documents, "payload")


@query
def folder_labels(spark, folder):
    documents = D.table(spark, folder, "documents")
    kind = F.pmod("doc_id", F.lit(4))
    name = F.when(kind == 0, "Spam_2").when(kind == 1, "easy_ham").when(kind == 2, "misc").otherwise("nospam")
    paths = documents.select("doc_id", F.concat(F.lit("file:/mail/ham/"), name, F.lit("/"), F.col("doc_id"), F.lit(".eml")).alias("path"))
    return C.label_from_path(paths).select("doc_id", "label", "source", "ai_assisted")


# --- results and correlation ----------------------------------------------------------


@query
def decoded_results(spark, folder):
    decoded = R.decode_messages(D.event_messages(spark, folder), schemas.RESULT)
    valid, _ = R.split_dlq(decoded)
    accepted = R.accept_results(valid)
    return accepted.select("seq", "task_id", "analyzer_type", "score", F.replace("features", F.lit(" "), F.lit("")).alias("features"))


@query
def dead_letters(spark, folder):
    _, dead = R.split_dlq(R.decode_messages(D.event_messages(spark, folder), schemas.RESULT))
    return dead.groupBy("topic", "error", "raw").agg(F.count("*").alias("n"))


@query
def skipped_tasks(spark, folder):
    decoded = R.decode_messages(D.event_messages(spark, folder), schemas.RAW_TASK)
    kept, _ = R.drop_unusable(decoded)
    return kept.groupBy("task_id").agg(F.count("*").alias("n"))


@query
def contract_check(spark, folder):
    results = D.event_results(spark, folder).withColumn("score", F.col("score") * 1.5)
    _, bad = R.check_result(results, strict=True)
    return bad.select("seq", "violation")


@query
def contract_strict_results(spark, folder):
    results = D.event_results(spark, folder).withColumn("score", F.col("score") * 1.5)
    good, _ = R.check_result(results, strict=True)
    return good.select("seq", "analyzer_type", "score")


def _with_copies(spark, folder) -> DataFrame:
    results = D.event_results(spark, folder)
    copies = results.filter(F.pmod("seq", F.lit(3)) != 0).withColumn("ts_ms", F.col("ts_ms") + 1000).withColumn(
        "seq", F.col("seq") + 1_000_000_000
    )
    return results.unionByName(copies)


@query
def message_dedup(spark, folder):
    return R.dedup_messages(_with_copies(spark, folder), "task_id").select("task_id", "analyzer_type", "score", "ts_ms", "seq")


@query
def task_correlation(spark, folder):
    return J.correlate(D.event_results(spark, folder))


@query
def arrival_positions(spark, folder):
    results = D.event_results(spark, folder, per_day=False)
    return J.arrival_positions(results, slot_ms=DAY_MS).select("task_id", "seq", "position")


@query
def nested_results(spark, folder):
    """Users as tasks, ten results to a row, so most tasks go on in further chunks."""
    nested = J.nest_results(D.event_results(spark, folder, per_day=False), max_rows=10, slot_ms=DAY_MS)
    return nested.select(
        "task_id", "chunk", F.size("results").alias("n"),
        F.array_join(F.transform("results", lambda r: F.concat(r["analyzer_type"], F.lit("="), _decimal_text(r["score"]))), "|").alias("items"),
    )


@query
def first_arrivals(spark, folder):
    return J.first_arrivals(D.event_results(spark, folder, per_day=False), timeout_ms=3 * DAY_MS)


def _aggregates(spark, folder, factor: float = 1.0) -> DataFrame:
    """Users as tasks, ten results to a row, so most tasks go on in further chunks."""
    results = D.event_results(spark, folder, per_day=False).withColumn("score", F.col("score") * factor)
    return J.nest_results(results, max_rows=10, slot_ms=DAY_MS)


@query
def task_verdicts(spark, folder):
    """One row per task, with the scores of its first chunk."""
    decided = W.decide(_aggregates(spark, folder), _moment())
    scores = F.array_join(F.transform("individual_scores", _decimal_text), "|")
    return decided.select("task_id", "verdict", "score", "analyzer_count", scores.alias("individual_scores"), "decided_at")


@query
def verdict_reasons(spark, folder):
    details = W.verdict_details(_aggregates(spark, folder))
    return details.select("task_id", "chunk", F.array_join("reasons", "|").alias("reasons"))


@query
def verdict_rows(spark, folder):
    rows = W.to_verdict_row(W.decide(_aggregates(spark, folder), _moment()))
    return rows.select(
        "email_id", "overall_risk", "ai_assistance_score", "classification", "cluster_id",
        F.get_json_object("full_verdict", "$.verdict").alias("blob_verdict"),
        F.get_json_object("full_verdict", "$.analyzer_count").cast("int").alias("blob_count"),
        F.date_format("decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
    )


@query
def out_of_scale_letters(spark, folder):
    _, dead = W.split_verdicts(W.decide(_aggregates(spark, folder, 2.25), _moment()))
    return dead.select("task_id", "reason", "at")


def _verdict_table(spark, folder) -> DataFrame:
    """Verdict table of the complete tasks, each decided at its last result."""
    done = J.correlate(D.event_results(spark, folder)).filter("complete")
    return done.select(
        F.col("task_id").alias("email_id"), F.col("verdict").alias("overall_risk"), F.col("score").alias("ai_assistance_score"),
        F.timestamp_millis("last_ms").alias("decided_at"),
    )


@query
def latest_verdicts(spark, folder):
    newest = W.latest_verdicts(_verdict_table(spark, folder), 5)
    return newest.withColumn("decided_at", F.unix_millis("decided_at"))


@query
def verdict_lookup(spark, folder):
    rows = _verdict_table(spark, folder)
    found = W.verdicts_of(rows, rows.agg(F.min("email_id")).first()[0])
    return found.withColumn("decided_at", F.unix_millis("decided_at"))


STATUS_NOW, STATUS_TTL = "2024-01-20 00:00:00", 10 * 86400


def _tasks_and_verdicts(spark, folder) -> tuple[DataFrame, DataFrame]:
    tasks = D.event_results(spark, folder).groupBy("task_id").agg(F.timestamp_millis(F.min("ts_ms")).alias("created_at"))
    verdicts = _verdict_table(spark, folder).select(
        F.col("email_id").alias("task_id"), "decided_at", F.col("overall_risk").alias("verdict"), F.col("ai_assistance_score").alias("score")
    )
    return tasks, verdicts


@query
def task_status(spark, folder):
    return W.task_status(*_tasks_and_verdicts(spark, folder), F.lit(STATUS_NOW).cast("timestamp"), ttl_seconds=STATUS_TTL)


@query
def contract_verdicts(spark, folder):
    whole = W.full_verdict(_aggregates(spark, folder), decided_at=_moment())
    return whole.select(
        "email_id", "overall_risk", "ai_assistance_score", F.size("signals").alias("n_signals"),
        _decimal_text(F.col("signals")["text"]["score"]).alias("text_signal"),
        F.array_join(F.sort_array("rules_applied"), "|").alias("rules"),
        F.col("campaign_context.variations_detected").alias("variations"), "model_version",
    )


@query
def message_envelopes(spark, folder):
    documents = D.table(spark, folder, "documents").select("doc_id", "lang", "source")
    return W.envelope(documents, "parser", "doc_id", _moment())


def _replayed(spark, folder, **options) -> DataFrame:
    replayed = replay_aggregation(D.event_results(spark, folder, per_day=False), REPLAY, **options)
    shown = F.array_join(F.transform("results", lambda r: F.concat(r["analyzer_type"], F.lit("="), _decimal_text(r["score"]))), "|")
    return replayed.select("task_id", "opened_ms", "opened_seq", "last_ms", "status", "n_results", shown.alias("items"))


@query
def replayed_episodes(spark, folder):
    return _replayed(spark, folder)


@query
def replayed_episodes_split(spark, folder):
    """The same with every task cut into blocks of time, as only very large ones are otherwise."""
    return _replayed(spark, folder, split_rows=0, reaches_per_block=2)


@query
def timeout_letters(spark, folder):
    replayed = replay_aggregation(D.event_results(spark, folder, per_day=False), REPLAY)
    letters = R.timeout_letters(replayed, F.timestamp_millis(F.col("opened_ms") + REPLAY.timeout_ms))
    return letters.select("task_id", "reason", F.substring("at", 1, 19).alias("at"))


@query
def branch_union(spark, folder):
    """Text results of the documents and HTML results of the pages, correlated by id."""
    documents = D.phrased_documents(spark, folder).withColumn("task_id", F.col("doc_id").cast("string"))
    pages = D.linked_pages(spark, folder)
    union = J.union_branches(
        scoring.score_text(documents, _moment()), scoring.score_html(pages, _moment()),
        scoring.score_images(pages.select("task_id"), _moment()), scoring.score_links(pages, None, _moment()),
    )
    stamped = union.withColumn("ts_ms", F.lit(0).cast("long"))
    return J.correlate(stamped).drop("first_ms", "last_ms")


def _paged_tasks(spark, folder) -> DataFrame:
    """Documents with the page of the same number as HTML part."""
    accepted, _ = intake.validate_intake(D.phrased_documents(spark, folder))
    pages = D.linked_pages(spark, folder).select(F.col("page_id").alias("doc_id"), "html")
    tasks = accepted.join(pages, "doc_id", "left").withColumn("task_id", F.col("doc_id").cast("string"))
    return tasks.select("task_id", "text", "html")


def _shown_verdicts(scored: DataFrame) -> DataFrame:
    decided = W.decide(scored, _moment(), checked=True)
    scores = F.array_join(F.transform("individual_scores", _decimal_text), "|")
    return decided.select("task_id", "verdict", "score", "analyzer_count", scores.alias("individual_scores"))


@query
def message_verdicts(spark, folder):
    """From raw task to verdict, with a list of suspicious domains."""
    return _shown_verdicts(scoring.score_messages(_paged_tasks(spark, folder), _moment(), domains=D.suspicious_domains(spark, folder)))


@query
def model_verdicts(spark, folder):
    """The same with a plugged-in model for the text."""
    return _shown_verdicts(
        scoring.score_messages(_paged_tasks(spark, folder), _moment(), make_predict=_stand_in_model, domains=D.suspicious_domains(spark, folder))
    )


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; only a local session may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="mailprism-")
    return f"{base.rstrip('/')}/mailprism-{uuid.uuid4()}"


# --- corpora, metrics, models ---------------------------------------------------------


@query
def corpus_union(spark, folder):
    whole = C.union_corpora(D.labelled_documents(spark, folder), D.conversation_corpus(spark, folder).filter("text is null"), D.conversation_corpus(spark, folder))
    return C.corpus_summary(whole)


@query
def text_dedup(spark, folder):
    documents = D.table(spark, folder, "documents").select("text", "lang", F.col("doc_id").alias("seq"))
    return C.dedup_text(documents).select("seq", "lang")


@query
def split_by_hash(spark, folder):
    parts = C.stratified_split(D.labelled_documents(spark, folder), "label", "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1})
    return parts.select("doc_id", "split")


@query
def split_exact(spark, folder):
    parts = C.stratified_split(
        D.labelled_documents(spark, folder), "label", "doc_id", {"train": 0.8, "test": 0.2}, exact=True, slots=64
    )
    return parts.select("doc_id", "label", "split")


@query
def shuffled_corpus(spark, folder):
    """The place of each document in the shuffled corpus, counted from the sorted rows."""
    ordered = C.seeded_shuffle(D.table(spark, folder, "documents").select("doc_id", "text"), key="doc_id")
    placed = cut_lineage(ordered.select("doc_id", F.monotonically_increasing_id().alias("place"), F.lit(0).alias("whole")))
    return ranked_in_slots(placed, ["whole"], F.shiftright("place", 33), ["place"], "position").select("doc_id", "position")


def _two_logits() -> Column:
    """Two logits of a whole vector: the sums of its components at even and at odd places."""

    def total(rest: int) -> Column:
        half = F.filter("embedding", lambda x, i: F.pmod(i, F.lit(2)) == rest)
        return F.aggregate(half, F.lit(0.0), lambda a, x: a + x.cast("double"))

    return F.array(total(0), total(1))


def _rated(spark, folder) -> DataFrame:
    """Embeddings as logits of as many classes, by whether the class is odd; label 1 against the rest."""
    vectors_table = D.table(spark, folder, "embeddings")
    odd = F.pmod(vectors.argmax("embedding"), F.lit(2)).cast("int")
    return vectors_table.select("vec_id", (F.col("label") % 2).alias("label"), odd.alias("prediction"))


@query
def softmax_scores(spark, folder):
    table = D.table(spark, folder, "embeddings")
    p = vectors.softmax("embedding")
    return table.select(
        "vec_id", vectors.argmax("embedding").alias("best"), F.round(F.element_at(p, 2), 9).alias("p1"),
        X.text_reason(vectors.positive_probability(_two_logits())).alias("reason"),
    )


@query
def accuracy_precision_recall(spark, folder):
    rates = metrics.binary_metrics(_rated(spark, folder))
    return rates.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def area_under_curve(spark, folder):
    """Text length as the score of low quality, rounded so that many scores tie."""
    labels = D.table(spark, folder, "labels")
    documents = D.table(spark, folder, "documents").select("doc_id", F.round(F.col("n_chars") / 1000.0, 1).alias("score"))
    rated = documents.join(labels, "doc_id").select((1 - F.col("quality")).alias("label"), "score")
    return metrics.roc_auc(rated, slots=16).select(F.round("roc_auc", 9).alias("roc_auc"))


@query
def classification_report(spark, folder):
    report = metrics.classification_report(_rated(spark, folder))
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def confusion_counts(spark, folder):
    return metrics.confusion_counts(_rated(spark, folder))


@query
def class_weights(spark, folder):
    weights = metrics.class_weights(D.table(spark, folder, "embeddings"))
    return weights.withColumn("weight", F.round("weight", 9))


def _campaign_messages(spark, folder) -> DataFrame:
    """Whole documents with a number behind, so that copies differ in digits only."""
    documents = D.text_table(spark, folder, "documents")
    numbered = F.concat("text", F.lit(" order "), F.pmod("doc_id", F.lit(7)).cast("string"))
    return documents.select("doc_id", X.clean_text(numbered).alias("clean"))


@query
def message_campaigns(spark, folder):
    return G.campaigns(_campaign_messages(spark, folder), "clean")


@query
def campaign_members(spark, folder):
    messages = cut_lineage(_campaign_messages(spark, folder))
    return G.with_campaign(messages, "doc_id", "clean", G.campaigns(messages, "clean"))


@query
def similar_campaigns(spark, folder):
    """Campaigns of similar documents, which come in two batches; the members of both."""
    store = CampaignStore(spark, f"{_scratch(spark)}/campaigns")
    messages = _campaign_messages(spark, folder)
    for batch in range(2):
        store.add(messages.filter(F.pmod("doc_id", F.lit(2)) == batch), "doc_id", "clean", batch)
    members = store.members().select("email_id", "cluster_id")
    sizes = store.campaigns(1).select("cluster_id", "messages", "variations_detected")
    return members.join(sizes, "cluster_id")


@query
def template_filling(spark, folder):
    documents = D.table(spark, folder, "documents")
    template = F.concat(F.col("source"), F.lit(": order {n} in {d} hours, {company}; again {n}"))
    return documents.select("doc_id", fill(template, 42, "doc_id").alias("text"))


@query
def expanded_corpus(spark, folder):
    """Conversation turns grown by thirty variants each, templates added, copies dropped."""
    return expand_corpus(D.conversation_corpus(spark, folder), "doc_id")


@query
def baseline_predictions(spark, folder):
    """Train on four fifths of the labelled documents and turns, predict the rest."""
    corpus = C.union_corpora(D.labelled_documents(spark, folder), D.conversation_corpus(spark, folder).withColumn("doc_id", -F.col("doc_id") - 1))
    parts = cut_lineage(C.stratified_split(training.clean_corpus(corpus), "ai_assisted", "doc_id", {"train": 0.8, "test": 0.2}))
    train = parts.filter(F.col("split") == "train")
    model = training.train_baseline(train, "doc_id", f"{_scratch(spark)}/model")
    test = parts.filter(F.col("split") == "test").select("doc_id", "clean", "ai_assisted")
    return training.predict(model, test).drop("clean")


@query
def baseline_evaluation(spark, folder):
    predictions = cut_lineage(QUERIES["baseline_predictions"](spark, folder))
    return training.evaluate(predictions, "ai_assisted")


# --- streams --------------------------------------------------------------------------


def _run_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over the files present into a Parquet folder, and read that back."""
    place, key = _scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    # Keyed state in several parts needs this store.
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        running = (
            stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def _stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = D.table(spark, folder, name).schema
    # A pattern with one match: a stream takes no path of a file, and a table may be a file or a folder.
    files = spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")
    # One file is one task; a topic would bring its own partitions.
    return files.repartition(spark.sparkContext.defaultParallelism)


@query
def stream_scoring(spark, folder):
    """Documents as a stream of raw tasks, scored by all analyzers."""
    documents = _stream_table(spark, folder, "documents")
    message = F.to_json(F.struct(F.col("doc_id").cast("string").alias("task_id"), D.phrased_text().alias("text")))
    messages = documents.select(message.alias("value"))
    scored = _run_stream(spark, flow.score_stream(messages, F.lit("2024-02-01")))
    return scored.select("task_id", "analyzer_type", "score", "reason")


@query
def stream_verdicts(spark, folder):
    """Raw tasks to verdicts in one stateless stream."""
    documents = _stream_table(spark, folder, "documents")
    message = F.to_json(F.struct(F.col("doc_id").cast("string").alias("task_id"), D.phrased_text().alias("text")))
    tasks = flow.task_stream(documents.select(message.alias("value")))
    decided = _run_stream(spark, flow.verdict_stream(scoring.score_messages(tasks, F.lit("2024-02-01")), F.lit("2024-02-01").cast("timestamp"), checked=True))
    return decided.select("task_id", "verdict", "score", "analyzer_count")


END_OF_STREAM = "end of stream"


def _in_batches(spark: SparkSession, results: DataFrame, disorder_ms: int, slices: int = 4) -> DataFrame:
    """Rows as a stream of some batches; a row may come up to `disorder_ms` too late, and a last one ends the stream.

    The last row belongs to a task of its own, so late that the watermark passes all others.
    """
    place, parts = _scratch(spark), spark.sparkContext.defaultParallelism
    first, last = results.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    width = (last - first + disorder_ms) // slices + 1 if first is not None else 1
    shifted = F.col("ts_ms") - F.lit(first or 0) + F.pmod(F.xxhash64(*results.columns), F.lit(disorder_ms))
    staged = cut_lineage(results.withColumn("slice", F.floor(shifted / width)))
    for number in range(slices):
        mine = staged.filter(F.col("slice") == number).drop("slice")
        mine.repartition(parts).write.mode("append").parquet(f"{place}/in")
    end = spark.range(1).select(F.lit(END_OF_STREAM).alias("task_id"), F.lit((last or 0) + 10 * disorder_ms).cast("long").alias("ts_ms"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema.fields if f.name not in end.columns]
    end.select("*", *missing).select(results.columns).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(results.schema).option("maxFilesPerTrigger", parts).parquet(f"{place}/in")


@query
def stream_aggregation(spark, folder):
    """Keyed buffers with deadline over results that come out of order, event time as the clock."""
    stream = _in_batches(spark, D.event_results(spark, folder, per_day=False), 2 * DAY_MS)
    stream = stream.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "2 days")
    closed = _run_stream(spark, aggregate_stream(stream, REPLAY, event_time="at"))
    shown = F.array_join(F.transform("results", lambda r: F.concat(r["analyzer_type"], F.lit("="), _decimal_text(r["score"]))), "|")
    return closed.select("task_id", "opened_ms", "last_ms", "status", "n_results", shown.alias("items"))


@query
def stream_task_status(spark, folder):
    """Tasks and verdicts as two streams; the status that their changes leave."""
    tasks, verdicts = _tasks_and_verdicts(spark, folder)
    tasks = _in_batches(spark, tasks.select("task_id", F.unix_millis("created_at").alias("ts_ms")), 2 * DAY_MS)
    verdicts = _in_batches(spark, verdicts.select("task_id", F.unix_millis("decided_at").alias("ts_ms"), "verdict", "score"), 2 * DAY_MS)
    changes = _run_stream(spark, status_stream(
        tasks.select("task_id", F.timestamp_millis("ts_ms").alias("created_at")).withWatermark("created_at", "2 days"),
        verdicts.select("task_id", F.timestamp_millis("ts_ms").alias("decided_at"), "verdict", "score").withWatermark("decided_at", "2 days"),
        STATUS_TTL,
    ))
    changes = changes.filter(F.col("task_id") != END_OF_STREAM)
    return current_status(changes, F.lit(STATUS_NOW).cast("timestamp"), STATUS_TTL)
