"""Text cleaning, keyword scoring, tokens and n-grams."""

from __future__ import annotations

import html as html_entities
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism.functions.common import as_column, let

# The substrings whose distinct hits drive the keyword score.
KEYWORDS = [
    "urgent", "immediately", "verify", "password", "account", "confirm",
    "срочно", "немедленно", "подтвердите", "парол", "аккаунт", "заблокирован",
]
KEYWORDS_FOR_FULL_SCORE = 4.0
KEYWORD_REASON = "heuristic fallback: trained text model is not mounted"
KEYWORD_MODEL = "heuristic-fallback"

# Lower bounds of the model score and what they are reported as.
MODEL_REASONS = [
    (0.8, "strong AI-generated writing patterns"),
    (0.6, "probable AI assistance in writing style"),
    (0.4, "mixed signals: style between human and AI"),
]
MODEL_REASON_LOW = "no strong AI-writing patterns"

# Java's \s and \w know ASCII only; these are the Unicode classes the cleaner means.
_SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOCAL = r"[\p{L}\p{N}_.+-]"
_URL = rf"(?:(?i:https?://|www\.))[^{_SPACE}]+"
# A run of local-part characters is tried once, from its start (or from the end of the
# previous match), so a long run without "@" costs linear and not quadratic time.
_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[\p{{L}}\p{{N}}_-]++\.[\p{{L}}\p{{N}}_.-]++"
_SPACES = rf"[{_SPACE}]+"
# Letters and digits of ASCII come first, so that Java seldom asks for the class of a character.
_TOKEN = r"[a-z0-9\p{L}\p{N}_]{2,}+"

# Text made only of these characters, with no entity, is its own NFKC form: ASCII,
# Latin-1 letters, basic Cyrillic and the usual quotes and dashes.
_ENTITY = r"&[^\t\n\f <&;]"
# One union of all of them is slow in Java, so the kinds are ruled out one after the other, the
# most frequent first, and only behind a character beyond ASCII.
_UNSTABLE = (
    r"[^\x00-\x7f](?<![\u0400-\u045f])(?<![\u00c0-\u00ff])"
    r"(?<![\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u20ac])"
)
# Control characters and the white space that can be left in cleaned text; NFKC has turned the
# other kinds into blanks. A single blank between words stays as it is.
_BLANK = r"[\x00-\x20\x7f\x85\u1680\u2028\u2029]"
_BLANKS = rf"(?: (?={_BLANK})|{_BLANK}(?<! )){_BLANK}*+"
_TAG = re.compile(r"<[^>]+>")


def strip_tags(text: Column | str) -> Column:
    """Replace every `<...>` by a space.

    Nothing after the last `>` can be a tag, so the tail is set aside: a long run of `<`
    is then never scanned to the end of the text once per character.
    """
    value = as_column(text)
    tail = F.substring_index(value, ">", -1)
    head = F.left(value, F.length(value) - F.length(tail))
    stripped = F.concat(F.regexp_replace(head, r"<[^>]++>", " "), tail)
    return F.when(F.contains(value, F.lit("<")), stripped).otherwise(value)


def strip_html(html: Column | str) -> Column:
    """Reduce HTML to plain text: tags out, white space collapsed."""
    plain = strip_tags(F.coalesce(as_column(html), F.lit("")))
    return F.trim(F.regexp_replace(plain, _SPACES, " "))


def _mask_and_fold(plain: Column) -> Column:
    # Searching for a plain string is much faster than a pattern, and most texts have no address.
    linked = F.contains(plain, F.lit("://")) | F.contains(F.lower(plain), F.lit("www."))
    masked = F.when(linked, F.regexp_replace(plain, _URL, " url ")).otherwise(plain)
    masked = F.when(F.contains(masked, F.lit("@")), F.regexp_replace(masked, _EMAIL, " email ")).otherwise(masked)
    return F.lower(F.trim(F.regexp_replace(masked, _BLANKS, " ")))


def _needs_unicode(text: Column) -> Column:
    """Cheap tests first: an ampersand at all, any character beyond ASCII at all."""
    entity = F.contains(text, F.lit("&")) & F.rlike(text, F.lit(_ENTITY))
    return entity | ((F.octet_length(text) != F.length(text)) & F.rlike(text, F.lit(_UNSTABLE)))


@F.arrow_udf(T.StringType())
def _unescape_and_normalize(texts: pa.Array) -> pa.Array:
    def one(text: str) -> str:
        return unicodedata.normalize("NFKC", _TAG.sub(" ", html_entities.unescape(text)))

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def clean_text_native(text: Column | str) -> Column:
    """The cleaner for text that holds no entity and is already in NFKC form."""
    return _mask_and_fold(strip_tags(F.coalesce(as_column(text), F.lit(""))))


def clean_text(text: Column | str) -> Column:
    """Unescape, drop tags, NFKC, mask URLs and addresses, drop controls, fold.

    Entities and NFKC have no Spark builtin. Only texts that hold an entity or a character
    outside the set known to be stable go through the Arrow function; it sees NULL for all
    others, so ordinary mail never leaves the JVM.
    """
    value = F.coalesce(as_column(text), F.lit(""))
    by_python = _unescape_and_normalize(F.when(_needs_unicode(value), value))
    return _mask_and_fold(F.coalesce(by_python, strip_tags(value)))


def keyword_hits(clean: Column | str) -> Column:
    value = as_column(clean)
    hits = F.lit(0)
    for word in KEYWORDS:
        hits = hits + F.contains(value, F.lit(word)).cast("int")
    return hits


def keyword_score(clean: Column | str) -> Column:
    """Distinct keywords found, four of them make 1.0."""
    return F.least(keyword_hits(clean) / F.lit(KEYWORDS_FOR_FULL_SCORE), F.lit(1.0))


def keyword_features(clean: Column | str) -> Column:
    return F.struct(
        F.lit(KEYWORD_MODEL).alias("model_version"),
        F.length(as_column(clean)).alias("clean_length"),
        F.lit("cpu").alias("device"),
        F.lit(False).alias("model_available"),
    )


def text_reason(score: Column | str) -> Column:
    """What a model score is reported as."""
    value = as_column(score)
    (first_bound, first_text), *others = MODEL_REASONS
    reason = F.when(value >= first_bound, first_text)
    for bound, text in others:
        reason = reason.when(value >= bound, text)
    return reason.otherwise(MODEL_REASON_LOW)


def word_tokens(clean: Column | str) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(as_column(clean), F.lit(_TOKEN), F.lit(0))


def word_ngrams(tokens: Column | str) -> Column:
    """The tokens, then each neighbouring pair joined by a space."""

    def with_pairs(words: Column) -> Column:
        rest = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(
            F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.concat(words, pairs)

    return let(as_column(tokens), with_pairs)


def display_text(text: Column | str, width: int = 70) -> Column:
    return F.substring(as_column(text), 1, width)


def display_label(probability: Column | str) -> Column:
    return F.when(as_column(probability) > 0.5, "AI").otherwise("HUMAN")
