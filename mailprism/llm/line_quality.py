"""Quality rules: counts within a document, and how often its lines occur elsewhere.

Everything is a DataFrame expression. The base looks at one document: too few words, or
too many words inside repeated three-word windows. The cross-document rule hashes each
line in a normal form, counts the different texts of a host that hold it, and removes lines
above a limit everywhere but in the document where they come first; a document that has
too little left is rejected. The limit is a share of the host's different texts with a floor
of a few, so the rule acts alike on small hosts and large ones.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import written

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
# A line is no content of its own in more different texts of a host than this many, and than
# this share of them.
MAX_TEXTS, MAX_TEXTS_PERCENT = 5, 5
# A document is depleted with fewer words left, or a smaller share of them.
MIN_LEFT_WORDS, MIN_LEFT_PERCENT = 50, 30

_SPACE_RUN = r"[\x20\x09-\x0D]+"
_WORD, _SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
# Letters to lower case and digits to zero in one pass.
_PLAIN = string.ascii_uppercase + "123456789", string.ascii_lowercase + "0" * 9


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE_RUN), lambda w: w != "")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))


def _normal(line: Column) -> Column:
    """Case, digits and the amount of white space do not tell lines apart."""
    return F.translate(F.trim(F.regexp_replace(line, _SPACE_RUN, " ")), *_PLAIN)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    A window is its 64-bit hash without the low bits, which hold its position: sorted,
    equal windows stand side by side. For n words the chance of a wrong count is n^3 / 2^65.
    """

    def counted(w: Column) -> Column:
        low = F.length(F.bin(F.size(w).cast("long")))
        # A variable number of bits to shift by is written in SQL's function form.
        shift = lambda name, value: F.call_function(name, value, low)
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        keys = F.sort_array(F.transform(starts, lambda i: shift("shiftleft", window(i)).bitwiseOR(i.cast("long"))))

        def twice(sorted_keys: Column) -> Column:
            same = lambda v, at: F.coalesce(
                shift("shiftright", v) == shift("shiftright", F.get(sorted_keys, at)), F.lit(False)
            )
            found = F.filter(sorted_keys, lambda v, i: same(v, i - 1) | same(v, i + 1))
            mask = shift("shiftleft", F.lit(1).cast("long")) - 1
            return F.sort_array(F.transform(found, lambda v: v.bitwiseAND(mask)))

        def covered(places: Column) -> Column:
            reach = F.transform(places, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(places, i + 1) - p, F.lit(3).cast("long"))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b)

        return _let(_let(keys, twice), covered)

    return _let(words, counted)


def base_measures(text: Column) -> dict[str, Column]:
    """The counts of one document; NULL has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = _lines(text)
    return {
        "n_words": F.regexp_count(text, F.lit(_WORD)).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _SPACE_RUN, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOL)).cast("long"),
        "n_dup_lines": _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": _repeated_words(_words(text)),
    }


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def _judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_texts: int = MAX_TEXTS, max_texts_percent: int = MAX_TEXTS_PERCENT,
    min_left_words: int = MIN_LEFT_WORDS, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The result of `judge_documents`, and in `bad` the hashes of the lines to be removed, NULL for none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(
        _lines(text), lambda line: F.struct(F.xxhash64(_normal(line)).alias("h"), F.regexp_count(line, F.lit(_WORD)).alias("n"))
    )
    measures = base_measures(F.col(text_col))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
        F.xxhash64(text).alias("digest"), lines.alias("lines"), *(c.alias(name) for name, c in measures.items()),
    )
    rows = written(rows, "quality")

    once = rows.select("host", "digest", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    texts = once.groupBy("host", "h", "digest").agg(F.min("doc_id").alias("least"))
    shared = texts.groupBy("host", "h").agg(F.count("*").alias("texts"), F.min("least").alias("first")).filter(
        F.col("texts") > max_texts
    )
    hosts = rows.select("host", "digest").distinct().groupBy(F.col("host").alias("of")).agg(F.count("*").alias("of_texts"))
    frequent = shared.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(
        100 * F.col("texts") > max_texts_percent * F.col("of_texts")
    ).select("of", F.col("h").alias("line"), "first")
    each = rows.select("rid", "host", "doc_id", F.explode("lines").alias("x")).select("rid", "host", "doc_id", "x.h", "x.n")
    # Hosts may be NULL on both sides: the hash finds the pairs, the null-safe test settles them.
    # Spark takes the lines for as few as the documents and would broadcast them: merge joins.
    hit = each.join(frequent.hint("merge"), (F.col("h") == F.col("line")) & F.col("host").eqNullSafe(F.col("of")))
    removed = hit.filter(~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("rid").agg(
        F.sum("n").cast("long").alias("removed"), F.collect_set("h").alias("bad")
    ).withColumnRenamed("rid", "in_row")
    out = rows.join(removed.hint("merge"), F.col("rid") == F.col("in_row"), "left").withColumn(
        "removed_words", F.coalesce("removed", F.lit(0).cast("long"))
    )
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & (
        (left < min_left_words) | (100 * left < min_left_percent * F.col("n_words"))
    )
    return out.select(
        "doc_id", *measures, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words", "host", "digest", "bad"
    )


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_texts: int = MAX_TEXTS, max_texts_percent: int = MAX_TEXTS_PERCENT,
    min_left_words: int = MIN_LEFT_WORDS, min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """One row per row of `docs`: the counts, `base_failed`, `removed_words` and `kept`.

    A line is removed if it stands in more than `max_texts` different texts of its host and
    in more than `max_texts_percent` of them. Exact copies of a document count once, for the
    line and for the host; a NULL host is a host of its own. NULL and empty texts fail the base. Rows
    that repeat are repeated. `host` and `digest` (XXH64 of the text) follow the counts.
    """
    return _judged(
        docs, id_col, text_col, host_col, max_texts, max_texts_percent, min_left_words, min_left_percent
    ).drop("bad")


def keep_good(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **parameters
) -> DataFrame:
    """The rows of `docs` that the rules keep, without their frequent lines; `chars_col`, if there, follows.

    Decisions are joined back by id, host and hash of the text, which decide them. The join
    is a merge at every size: the kept grow with the documents, so they cannot be broadcast.
    All other columns, and texts without such a line, stay as they were. NULL and empty texts
    fail the base and go; no documents give none; rows that repeat are repeated.
    """
    judged = _judged(docs, id_col, text_col, host_col, **parameters)
    # Equal keys have equal texts, so equal lines and one decision.
    stays = judged.filter("kept").groupBy(
        F.col("doc_id").alias("of_id"), F.col("host").alias("of_host"), F.col("digest").alias("of_digest")
    ).agg(F.first("bad").alias("bad_lines"))
    row = F.col("row")
    same = (
        row[id_col].eqNullSafe(F.col("of_id")) & row[host_col].eqNullSafe(F.col("of_host"))
        & (F.xxhash64(F.coalesce(row[text_col], F.lit(""))) == F.col("of_digest"))
    )
    good = docs.select(F.struct(*docs.columns).alias("row")).join(stays.hint("merge"), same)
    # Lines without a word have no hash of their own and stay.
    own = F.filter(F.split(row[text_col], "\n"), lambda line: (
        ~line.rlike(_WORD) | ~F.array_contains("bad_lines", F.xxhash64(_normal(line)))
    ))
    good = good.select("row", F.when(F.col("bad_lines").isNotNull(), F.array_join(own, "\n")).alias("left_text"))

    def value(name: str) -> Column:
        if name == text_col:
            return F.coalesce("left_text", row[name])
        if name == chars_col:
            kind = docs.schema[name].dataType
            return F.when(F.col("left_text").isNotNull(), F.length("left_text").cast(kind)).otherwise(row[name])
        return row[name]

    return good.select(*(value(c).alias(c) for c in docs.columns))
