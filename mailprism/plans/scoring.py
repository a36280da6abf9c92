"""Message scoring: all analyzers over one read of the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.functions import html as H
from mailprism.functions import image as I
from mailprism.functions import links as L
from mailprism.functions import text as X
from mailprism.functions.common import first_nonempty, iso_utc
from mailprism.plans.model_scoring import Predictor, model_score

# Suspicious domains that travel as literals of the plan; more are joined.
LITERAL_DOMAINS = 1_000


def _result(kind: str, score: Column, features: Column, reason: Column, at: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("analyzer_type"),
        score.cast("double").alias("score"),
        features.cast("string").alias("features"),
        reason.cast("string").alias("reason"),
        at.alias("analyzed_at"),
    )


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _with_text(df: DataFrame, exact: bool) -> DataFrame:
    cleaner = X.clean_text if exact else X.clean_text_native
    text = first_nonempty(_column(df, "text"), _column(df, "text_part"))
    return df.withColumn("_clean", cleaner(text))


def _with_model(df: DataFrame, make_predict: Predictor | None) -> DataFrame:
    """The plugged-in model's score of the cleaned text, where there is a model."""
    return df if make_predict is None else df.withColumn("_model_score", model_score("_clean", make_predict))


def _text_result(at: Column, model_version: str | None = None) -> Column:
    if model_version is None:
        return _result(
            "text", X.keyword_score("_clean"), F.to_json(X.keyword_features("_clean")), F.lit(X.KEYWORD_REASON), at
        )
    features = F.to_json(F.struct(F.length("_clean").alias("clean_length"), F.lit(model_version).alias("model_version")))
    return _result("text", F.col("_model_score"), features, X.text_reason("_model_score"), at)


def _with_html(df: DataFrame, exact: bool) -> DataFrame:
    html = first_nonempty(_column(df, "html"), _column(df, "html_part"))
    return H.with_html_features(df.withColumn("_html_text", html), "_html_text", exact)


def _html_result(at: Column) -> Column:
    return _result("html", H.html_score(), F.to_json(F.struct(*H.FEATURES)), H.html_reason(), at)


def _with_image(df: DataFrame) -> DataFrame:
    """Payload and header facts; QR texts, read elsewhere, come in as `qr_codes`."""
    codes = F.coalesce(_column(df, "qr_codes", "array<string>"), F.array().cast("array<string>"))
    if not {"image_data", "image_base64"} & set(df.columns):
        return _without_image(df).withColumn("_codes", codes)
    payload = I.decode_image_payload(_column(df, "image_data"), _column(df, "image_base64"))
    with_bytes = df.withColumn("_image", payload).withColumn("_codes", codes)
    probed = I.with_image_facts(with_bytes, "_image")
    return probed.drop("_image")


def _without_image(df: DataFrame) -> DataFrame:
    """The facts of an empty payload, for tasks that carry no image column at all."""
    none = F.lit(None)
    return (
        df.withColumn("n_bytes", F.lit(0))
        .withColumn("format", none.cast("string"))
        .withColumn("width", none.cast("int"))
        .withColumn("height", none.cast("int"))
        .withColumn("mode", none.cast("string"))
        .withColumn("metadata_keys", none.cast("array<string>"))
        .withColumn("decode_error", F.lit(False))
        .withColumn("_codes", F.array().cast("array<string>"))
    )


def _image_result(at: Column) -> Column:
    features = F.to_json(
        F.struct(
            F.col("n_bytes").alias("bytes"), F.col("_codes").alias("qr_codes"), "format", "width", "height", "mode",
            "metadata_keys",
        )
    )
    return _result(
        "images",
        I.image_score("n_bytes", "decode_error", "metadata_keys", "_codes"),
        features,
        I.image_reason("n_bytes", "decode_error", "_codes"),
        at,
    )


def _with_links(df: DataFrame) -> DataFrame:
    anchors = L.anchors("_html_text")
    links = L.extract_links("_html_text", first_nonempty(_column(df, "text"), _column(df, "text_part")))
    return df.withColumn("_anchors", anchors).withColumn("_links", links)


def _folded(domain: str) -> str:
    return domain.lower().removeprefix("www.").translate(str.maketrans(L.CONFUSABLE, L.LOOKS_LIKE))


def _link_result(at: Column, domains: Sequence[str] = (), bad: Column | None = None) -> Column:
    """`bad` is the number of suspicious links where it was counted elsewhere."""
    mismatches = F.size(F.filter("_anchors", lambda a: L.anchor_mismatch(a["href"], a["text"])))
    if bad is None:
        bad = F.lit(0)
    if domains:
        known = {_folded(d) for d in domains}
        listed = lambda link: F.exists(L.host_suffixes(L.url_host(link)), lambda s: s.isin(*known))
        bad = F.size(F.filter("_links", lambda link: F.coalesce(listed(link), F.lit(False))))
    features = F.to_json(
        F.struct(F.size("_links").alias("links"), mismatches.alias("anchor_mismatches"), bad.alias("suspicious_links"))
    )
    return _result("links-meta", L.link_score(mismatches, bad), features, L.link_reason(mismatches, bad), at)


def suspicious_counts(rows: DataFrame, suspicious: DataFrame) -> DataFrame:
    """(task_id, links_key, n): links to a listed domain or to one that lies in it, where there are any.

    `rows` has `task_id` and `_links`. Each host becomes its suffixes, which meet the list in
    one equality join; Spark broadcasts a short list, and puts a Bloom filter of a longer one
    before the shuffle. Only hits go on. Rows that repeat task and links count once.
    """
    known = suspicious.select(L.folded_host(F.col("domain")).alias("suffix")).filter("suffix <> ''").distinct()
    keyed = rows.select("task_id", F.xxhash64("_links").alias("links_key"), F.posexplode("_links").alias("place", "link"))
    suffixes = keyed.select("task_id", "links_key", "place", F.explode(L.host_suffixes(L.url_host("link"))).alias("suffix"))
    hits = suffixes.join(known, "suffix")
    return hits.groupBy("task_id", "links_key").agg(F.count_distinct("place").cast("int").alias("n"))


def _with_suspicious(rows: DataFrame, suspicious: DataFrame | None) -> DataFrame:
    """Add `_bad`, the number of suspicious links of each row."""
    if suspicious is None:
        return rows.withColumn("_bad", F.lit(0))
    found = suspicious_counts(rows, suspicious).select(F.col("task_id").alias("_task"), F.col("links_key").alias("_key"), F.col("n").alias("_n"))
    same = F.col("task_id").eqNullSafe(F.col("_task")) & (F.xxhash64("_links") == F.col("_key"))
    return rows.join(found, same, "left").withColumn("_bad", F.coalesce("_n", F.lit(0))).drop("_task", "_key", "_n")


def score_text(tasks: DataFrame, at: Column | None = None, exact: bool = True) -> DataFrame:
    """Text results: one row per task."""
    moment = iso_utc(F.current_timestamp()) if at is None else at
    return _with_text(tasks, exact).select("task_id", _text_result(moment).alias("r")).select("task_id", "r.*")


def score_html(tasks: DataFrame, at: Column | None = None, exact: bool = True) -> DataFrame:
    """HTML results: one row per task; the text column is not read."""
    moment = iso_utc(F.current_timestamp()) if at is None else at
    return _with_html(tasks, exact).select("task_id", _html_result(moment).alias("r")).select("task_id", "r.*")


def score_images(tasks: DataFrame, at: Column | None = None) -> DataFrame:
    """Image results; a payload that is not base64 is a malformed message and is skipped."""
    moment = iso_utc(F.current_timestamp()) if at is None else at
    return (
        _with_image(tasks).filter(F.col("n_bytes").isNotNull())
        .select("task_id", _image_result(moment).alias("r")).select("task_id", "r.*")
    )


def score_links(tasks: DataFrame, suspicious: DataFrame | None = None, at: Column | None = None) -> DataFrame:
    """Link results; `suspicious` is a table of any size with a `domain` column."""
    moment = iso_utc(F.current_timestamp()) if at is None else at
    html = first_nonempty(_column(tasks, "html"), _column(tasks, "html_part"))
    prepared = _with_links(tasks.withColumn("_html_text", html)).select("task_id", "_anchors", "_links")
    counted = _with_suspicious(prepared, suspicious)
    return counted.select("task_id", _link_result(moment, bad=F.col("_bad")).alias("r")).select("task_id", "r.*")


def score_messages(
    tasks: DataFrame, at: Column | None = None, exact: bool = True, make_predict: Predictor | None = None,
    model_version: str = "model", domains: Sequence[str] | DataFrame = (),
) -> DataFrame:
    """All four results of each task as an array, from one read and without a shuffle.

    Each analyzer of the message bus reads every task for itself. Here they are columns of
    the same row, so the tasks are scanned once and correlation costs nothing. With
    `make_predict` (see `score_text_model`) the text result is the model's.

    `domains` are suspicious domains, which stand for all hosts in them. Up to
    `LITERAL_DOMAINS` travel with the plan. More, or a frame with a `domain` column, are
    joined: the links are read once more for it, and the counts of the tasks that have hits
    come back by task. A stream, whose rows cannot be counted twice, takes literals only or is
    scored batch by batch in `foreachBatch`.
    """
    moment = iso_utc(F.current_timestamp()) if at is None else at
    if not isinstance(domains, DataFrame) and len(domains) > LITERAL_DOMAINS:
        domains = tasks.sparkSession.createDataFrame([(d,) for d in domains], "domain string")
    joined = domains if isinstance(domains, DataFrame) else None
    if joined is not None and tasks.isStreaming:
        raise ValueError(f"a stream takes at most {LITERAL_DOMAINS} domains; join a longer list in foreachBatch")
    has_image = {"image_data", "image_base64"} & set(tasks.columns)
    if joined is not None:
        html = first_nonempty(_column(tasks, "html"), _column(tasks, "html_part"))
        texts = tasks.withColumn("_html_text", html)
        found = suspicious_counts(_with_links(texts).select("task_id", "_links"), joined)
        found = found.select(F.col("task_id").alias("_task"), F.col("links_key").alias("_key"), F.col("n").alias("_n"))
    scored = _with_html(_with_model(_with_text(tasks, exact), make_predict), exact)
    scored = _with_links(_with_image(scored) if has_image else _without_image(scored))
    scored = scored.filter(F.col("n_bytes").isNotNull())
    results = [_text_result(moment, None if make_predict is None else model_version), _html_result(moment), _image_result(moment)]
    if joined is None:
        return scored.select("task_id", F.array(*results, _link_result(moment, domains)).alias("results"), moment.alias("aggregated_at"))
    same = F.col("task_id").eqNullSafe(F.col("_task")) & (F.xxhash64("_links") == F.col("_key"))
    scored = scored.select("task_id", "_links", "_anchors", F.array(*results).alias("_results"), moment.alias("aggregated_at"))
    scored = scored.join(found, same, "left")
    links = _link_result(moment, bad=F.coalesce("_n", F.lit(0)))
    return scored.select("task_id", F.concat("_results", F.array(links)).alias("results"), "aggregated_at")


def result_rows(scored: DataFrame) -> DataFrame:
    """The arrays of `score_messages` as one result per row, the form the bus carries.

    Every result has an analyzer type. The outer form, with the filter behind it, gives the rows
    of the plain one, but Spark derives no filter on `results` from it, which would repeat
    all of scoring many times over below the projections.
    """
    return scored.select("task_id", F.inline_outer("results")).filter(F.col("analyzer_type").isNotNull())
