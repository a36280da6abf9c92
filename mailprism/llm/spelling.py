"""Spelling variants: words one edit apart, found by asymmetric chunks.

A word that is not longer than its partner contributes two disjoint chunks, its halves; the
partner contributes all positional grams of their length. One edit touches one half at most,
so the other stands unchanged in the partner, at the same place or one further. Chunks and
grams are joined by text and place within that shift, and the join verifies the distance, so
only true pairs leave it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import written

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
NOISE = 199
# Different words a task counts before it passes their counts on.
HELD_WORDS = 1 << 19


def noisy(doc_id: int | None, run: str, noise: int = NOISE) -> str:
    """The run without one letter if its hash says so; a document without an id hashes as one of an empty id."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, noise: int):
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if not text.is_valid:
                    continue
                # bytes.lower() changes A-Z only.
                here: dict[str, int] = {}
                for run in runs.findall(text.as_buffer().to_pybytes().lower().decode()):
                    here[run] = here.get(run, 0) + 1
                prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in here.items():
                    if zlib.crc32(run.encode(), prefix) % noise == 0:
                        run = noisy(doc_id, run, noise)
                        if len(run) < least:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) >= HELD_WORDS:
                    yield out()
                    total.clear()
        yield out()

    return count


def corpus_words(
    docs: DataFrame, least: int = MIN_LETTERS, min_count: int = MIN_COUNT, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): words of at least `least` letters with at least `min_count` occurrences in all texts.

    A run of letters shorter than that cannot become such a word, so it is not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = rows.mapInArrow(_counted(least, noise), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def chunks(word: Column) -> Column:
    """The two halves of a word with their places, (place, chunk): equally long, a middle letter is in neither."""
    half = F.floor(F.length(word) / 2).cast("int")
    return F.array(*(F.struct(p.alias("place"), F.substr(word, p + 1, half).alias("chunk")) for p in (F.lit(0), F.length(word) - half)))


def grams(word: Column, length: Column) -> Column:
    """All grams of a word that are as long as the halves of a word of `length` letters, (place, gram)."""
    size = F.floor(length / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.length(word) - size),
        lambda p: F.struct(p.alias("place"), F.substr(word, p + 1, size).alias("gram")),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): words of the distinct column `word` exactly one inserted, deleted or replaced letter apart, each pair once.

    `a` is the shorter one, or the smaller of two equally long ones. Words of fewer than two
    letters have no halves and are left out.
    """
    words = words.select("word", F.length("word").alias("size")).filter("size >= 2")
    halves = words.select(F.col("word").alias("a"), F.col("size").alias("a_size"), F.inline(chunks(F.col("word"))))
    # The half may stand one place further to either side.
    halves = halves.select("a", "a_size", "chunk", F.explode(F.sequence(F.col("place") - 1, F.col("place") + 1)).alias("near_place"))
    partners = words.select(F.col("word").alias("b"), F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("b_size"))
    partners = partners.filter("b_size >= 2").select("b", "b_size", F.inline(grams(F.col("b"), F.col("b_size"))))
    # A gram whose place no half of such a word can reach meets nothing.
    second = F.col("b_size") - F.floor(F.col("b_size") / 2)
    partners = partners.filter((F.col("place") <= 1) | F.col("place").between(second - 1, second + 1))
    close = (
        (F.col("a_size") == F.col("b_size")) & (F.col("near_place") == F.col("place")) & (F.col("chunk") == F.col("gram"))
        & ((F.length("b") > F.col("a_size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    )
    return halves.join(partners, close).select("a", "b").distinct()


def _roots(words: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last one. Each step at least multiplies the count, so ways are short."""
    to = written(words.select("word", F.coalesce("form", "word").alias("root")), "forms")
    while True:
        onward = to.filter("word <> root").select(F.col("word").alias("at"), F.col("root").alias("next"))
        joined = to.join(onward, F.col("root") == F.col("at"), "left")
        if joined.filter("next is not null").isEmpty():
            return to
        to = written(joined.select("word", F.coalesce("next", "root").alias("root")), "forms")


def spelling_variants(
    docs: DataFrame, least: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `corpus_words`.

    The form is the near word of the largest count, of equal ones the smallest by code points,
    if its count is at least `ratio` times the word's; else NULL. The root is reached by forms
    from form to form. A NULL text has no words; repeated rows count each; an empty table has
    no words. Other columns are not read.
    """
    words = written(corpus_words(docs, least, min_count, noise, id_col, text_col), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    best = both.join(counts, "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.max("n_b").alias("best_n"), F.min_by("b", F.struct(-F.col("n_b"), F.col("b"))).alias("best"),
    )
    found = words.join(best, F.col("word") == F.col("a"), "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = written(found.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    ), "variants")
    return found.join(_roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
