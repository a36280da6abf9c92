"""Term statistics and TF-IDF.

A limited vocabulary is found without shuffling the terms that cannot be in it. A count-min
sketch, dense arrays of counters that each task fills and that are added slice by slice, bounds
the frequency of every term from above. Only terms whose bound reaches a limit are counted
exactly. If the last term of the vocabulary so found is as frequent as the limit, no dropped
term can belong to it; else the limit is lowered to that frequency and the count repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailprism.functions.common import as_column, let
from mailprism.functions.text import word_ngrams, word_tokens
from mailprism.operators.ranking import ranked_in_slots
from mailprism.session import cut_lineage

# Vocabulary rules of the baseline model.
MIN_DF = 2
MAX_FEATURES = 20_000

# Counters of the sketch (32 MB), in slices that are added apart; tasks whose slices are added first.
SKETCH_BITS, SLICES, SALTS = 22, 64, 32
# Frequent counters aimed at, as a share of the vocabulary.
SPARE = 1.25
# More counters than this at the limit are not sent to the tasks; then all terms are counted.
_BROADCAST_COUNTERS = 500_000
# More terms than this make no vocabulary that a task looks terms up in.
_LOOKUP_TERMS = 200_000


def term_counts(grams: Column | str) -> Column:
    """Array of (term, tf) of one document.

    Sorting puts equal terms side by side, so only the starts of the runs are needed: a run
    ends where the next one starts.
    """

    def run_starts(ordered: Column) -> Column:
        opens = lambda term, i: (i == 0) | (term != F.try_element_at(ordered, F.greatest(i, F.lit(1))))
        places = F.transform(ordered, lambda term, i: F.when(opens(term, i), F.struct(i.alias("at"), term.alias("term"))))
        return F.struct(F.filter(places, lambda s: s.isNotNull()).alias("runs"), F.size(ordered).alias("n"))

    def counted(found: Column) -> Column:
        runs = found["runs"]
        starts = F.transform(runs, lambda s: s["at"])
        ends = F.concat(F.slice(starts, F.lit(2), F.size(runs)), F.array(found["n"]))
        pairs = F.zip_with(
            runs, ends, lambda s, end: F.struct(s["term"].alias("term"), (end - s["at"]).alias("tf"))
        )
        return F.slice(pairs, F.lit(1), F.size(runs))

    return let(let(F.sort_array(as_column(grams)), run_starts), counted)


def document_terms(docs: DataFrame, key: str, clean: str) -> DataFrame:
    """One row (key, term, tf) per distinct uni- or bigram of a document; no shuffle."""
    grams = docs.select(key, word_ngrams(word_tokens(clean)).alias("_grams"))
    return grams.select(key, F.inline(term_counts("_grams")))


def _counters(bits: int, slices: int):
    """Each task's counters of all hashes it is given, one row per slice that is not empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            places = batch.column("places").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(places, minlength=1 << bits)
        parts = [(i, part) for i, part in enumerate(total.reshape(slices, -1)) if part.any()]
        yield pa.RecordBatch.from_pydict({
            "slice": pa.array([i for i, _ in parts], pa.int32()),
            "counters": pa.array([zlib.compress(part.tobytes(), 1) for _, part in parts], pa.binary()),
        })

    return count


def _added(rows: Iterator[pd.DataFrame]) -> np.ndarray:
    total = np.zeros(0, np.int64)
    for frame in rows:
        for data in frame["counters"]:
            part = np.frombuffer(zlib.decompress(data), np.int64)
            total = total + part if len(total) else part
    return total


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "counters": [zlib.compress(_added([frame]).tobytes(), 1)]})


def _in_batch(grams: pa.ListArray, kept: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the codes below `n` of the kept grams, by row and code."""
    row = np.repeat(np.arange(len(grams)), pc.fill_null(pc.list_value_length(grams), 0).to_numpy())
    pairs, counts = np.unique(row[kept] * n + codes, return_counts=True)
    return pairs // n, pairs % n, counts


def _chosen_terms(shared, bits: int):
    """Frequencies in a batch of the terms whose counters are chosen; only these are sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << bits, bool)
        wanted[shared.value] = True
        for batch in batches:
            grams = batch.column("grams")
            kept = wanted[batch.column("places").flatten().to_numpy(zero_copy_only=False)]
            terms = grams.flatten().filter(pa.array(kept)).dictionary_encode()
            n = max(len(terms.dictionary), 1)
            row, code, tf = _in_batch(grams, kept, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), n)
            # By the first row of a term and then by the term: the order of one row per term and document,
            # which the vocabulary, and with it the places of a model's features, keeps.
            first = row[np.unique(code, return_index=True)[1]]
            places = np.argsort(pc.sort_indices(terms.dictionary).to_numpy())
            order = np.lexsort((places, first))
            sums = np.bincount(code, tf, len(order)).astype(np.int64), np.bincount(code, minlength=len(order))
            columns = [terms.dictionary.take(pa.array(order)), *(pa.array(v[order]) for v in sums)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "tf", "df"])

    return count


def _place(term: Column, bits: int) -> Column:
    """Counter of a term."""
    return F.xxhash64(term).bitwiseAND(F.lit((1 << bits) - 1))


def term_sketch(grams: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counters of all terms of the array column `grams`; a term occurs no more often than its counter says.

    Counters are added by slice, first within groups of tasks, so no task adds more than a
    slice of some tasks. The result has a fixed size.
    """
    slices = min(SLICES, 1 << bits)
    places = grams.select(F.transform("grams", lambda t: _place(t, bits)).alias("places"))
    rows = places.mapInArrow(_counters(bits, slices), "slice int, counters binary")
    rows = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in (["slice", "salt"], ["slice"]):
        rows = rows.groupBy(*keys).applyInPandas(_merge, "slice int, counters binary")
    total = np.zeros((slices, (1 << bits) // slices), np.int64)
    for number, data in rows.collect():  # at most SLICES rows
        total[number] = np.frombuffer(zlib.decompress(data), np.int64)
    return total.ravel()


def _counted(docs: DataFrame, key: str, clean: str, min_df: int, counters: DataFrame | None, bits: int) -> DataFrame:
    """Exact frequencies of terms in at least `min_df` documents, of all or those of some counters.

    Terms are counted per document before they are exploded, or per batch of documents those
    of some counters, and one shuffle on the term, partly summed before, gives both figures.
    """
    if counters is None:
        found = document_terms(docs, key, clean).withColumn("df", F.lit(1))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(counters.toPandas()["counter"].to_numpy(np.int64))
        grams = docs.select(word_ngrams(word_tokens(clean)).alias("grams"))
        placed = grams.select("grams", F.transform("grams", lambda t: _place(t, bits)).alias("places"))
        found = placed.mapInArrow(_chosen_terms(shared, bits), "term string, tf long, df long")
    counts = found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return counts.filter(F.col("df") >= min_df)


def _most_frequent(stats: DataFrame, n: int) -> tuple[DataFrame, int | None]:
    """The `n` terms of largest `tf`, ties by term, and the last one's `tf`; None if there are fewer.

    A histogram of `tf` gives the last one's frequency; only terms that tie with it are ranked.
    """
    above = 0
    # Each frequency has a term at least, so no more than n are needed.
    for tf, terms in stats.groupBy("tf").agg(F.count("*").alias("terms")).orderBy(F.desc("tf")).limit(n).collect():
        if above + terms >= n:
            break
        above += terms
    else:
        return stats, None
    ties = ranked_in_slots(stats.filter(F.col("tf") == tf), ["tf"], F.substring("term", 1, 3), ["term"], "place")
    ties = ties.filter(F.col("place") <= n - above)
    return stats.filter(F.col("tf") > tf).unionByName(ties.select(stats.columns)), tf


def term_stats(
    docs: DataFrame, key: str, clean: str, min_df: int = MIN_DF, max_features: int | None = MAX_FEATURES, bits: int = SKETCH_BITS
) -> DataFrame:
    """Term and document frequency of the vocabulary: `min_df` documents, then the top terms.

    Without `max_features` all terms are counted. With it, terms of small counters in the
    sketch are dropped before the shuffle, see above; the result is exact.
    """
    if max_features is None:
        return _counted(docs, key, clean, min_df, None, bits)
    if max_features <= 0:
        return _counted(docs, key, clean, min_df, None, bits).limit(0)
    sketch = term_sketch(docs.select(word_ngrams(word_tokens(clean)).alias("grams")), bits)
    wanted = min(int(max_features * SPARE), len(sketch))
    limit = int(np.partition(sketch, -wanted)[-wanted])
    while True:
        chosen = np.flatnonzero(sketch >= max(limit, 1))
        everything = limit <= 1 or len(chosen) > _BROADCAST_COUNTERS
        counters = None
        if not everything:
            counters = docs.sparkSession.createDataFrame(pd.DataFrame({"counter": chosen.astype(np.int64)}))
        stats = cut_lineage(_counted(docs, key, clean, min_df, counters, bits))
        top, last = _most_frequent(stats, max_features)
        if everything or (last is not None and last >= limit):
            return top
        limit = last if last is not None else limit // 4


def smooth_idf(df: Column | str, n_docs: Column | int) -> Column:
    total = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return F.log((1 + total) / (1 + as_column(df))) + 1.0


def _weights(shared):
    """Weighted terms of each row (key, grams), scaled to length one."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = shared.value
        vocabulary = pa.array(vocabulary, pa.string())
        for batch in batches:
            grams = batch.column("grams")
            place = pc.index_in(grams.flatten(), value_set=vocabulary)
            known = place.is_valid().to_numpy(zero_copy_only=False)
            codes = place.drop_null().to_numpy().astype(np.int64)
            row, code, tf = _in_batch(grams, known, codes, max(len(vocabulary), 1))
            raw = tf * idf[code]
            length = np.sqrt(np.bincount(row, raw * raw, minlength=len(batch)))
            columns = [batch.column(0).take(pa.array(row)), vocabulary.take(pa.array(code)), pa.array(raw / length[row])]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], "term", "weight"])

    return weigh


def tfidf(docs: DataFrame, key: str, clean: str, vocabulary: DataFrame, n_docs: int) -> DataFrame:
    """Rows (key, term, weight), each document scaled to length one.

    `vocabulary` comes from `term_stats`. Up to a bounded number of terms it goes to the
    tasks, and a document is weighed where it is read. A larger one is joined, and the window
    holds the terms of one document.
    """
    weight = vocabulary.select("term", smooth_idf("df", n_docs).alias("idf"))
    few = weight.limit(_LOOKUP_TERMS + 1).toPandas().sort_values("term")
    if len(few) <= _LOOKUP_TERMS:
        shared = docs.sparkSession.sparkContext.broadcast((few["term"].tolist(), few["idf"].to_numpy(float)))
        grams = docs.select(key, word_ngrams(word_tokens(clean)).alias("grams"))
        kind = docs.schema[key].dataType.simpleString()
        return grams.mapInArrow(_weights(shared), f"{key} {kind}, term string, weight double")
    weighted = document_terms(docs, key, clean).join(weight, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / length).alias("weight"))
