"""Vocabulary by sketch bounds against plain counts."""

import random
from collections import Counter

import numpy as np
import pytest

from mailprism.operators import terms
from pyspark.sql import functions as F


def documents(seed, n=120):
    rng = random.Random(seed)
    for i in range(n):
        # Frequencies fall with the rank, and many are equal.
        yield i, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}x" for _ in range(rng.randint(0, 60)))
    yield n, None
    yield n + 1, ""


def grams(text):
    words = [w for w in (text or "").split() if len(w) >= 2]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("bits", [22, 9, 3])
@pytest.mark.parametrize("n", [1, 40, 700, 100_000])
def test_vocabulary(spark, bits, n):
    rows = list(documents(n))
    tf, df = Counter(), Counter()
    for _, text in rows:
        tf.update(grams(text))
        df.update(set(grams(text)))
    want = sorted((-tf[t], t) for t in tf if df[t] >= 2)[:n]
    frame = spark.createDataFrame(rows, "id long, clean string").repartition(5)
    got = terms.term_stats(frame, "id", "clean", 2, n, bits).collect()
    assert sorted((-r.tf, r.term) for r in got) == want and all(r.df == df[r.term] for r in got)


def test_sketch_bounds_and_prunes(spark):
    rows = [(i, t) for i, t in documents(9, 400)]
    frame = spark.createDataFrame(rows, "id long, clean string").repartition(6)
    sketch = terms.term_sketch(frame.select(F.split("clean", " ").alias("grams")), 12)
    tf = Counter(w for _, t in rows for w in (t or "").split(" ") if t is not None)
    place = frame.sparkSession.createDataFrame([(w,) for w in tf], "w string").select("w", terms._place(F.col("w"), 12).alias("p")).collect()
    assert sum(sketch) == sum(tf.values()) and all(sketch[r.p] >= tf[r.w] for r in place)
    # Of the rows of rare terms few reach the shuffle.
    kept = []
    counted = terms._counted
    try:
        terms._counted = lambda *args: (kept.append(args[4]), counted(*args))[1]
        terms.term_stats(frame, "id", "clean", 2, 30)
    finally:
        terms._counted = counted
    found = terms.document_terms(frame, "id", "clean")
    through = found.join(kept[-1], terms._place(F.col("term"), terms.SKETCH_BITS) == F.col("counter"), "left_semi").count()
    assert len(kept) == 1 and through < found.count() / 2


def test_empty_corpus(spark):
    frame = spark.createDataFrame([], "id long, clean string")
    assert terms.term_stats(frame, "id", "clean").count() == 0
    assert terms.term_stats(frame.unionByName(spark.createDataFrame([(1, "aa bb")], frame.schema)), "id", "clean", 1, 0).count() == 0


def test_weights_of_both_ways_agree(spark, monkeypatch):
    frame = spark.createDataFrame(list(documents(5)), "id long, clean string").repartition(3)
    vocabulary = terms.term_stats(frame, "id", "clean", 2, 300)
    shown = lambda df: {(r.id, r.term): round(r.weight, 12) for r in df.collect()}
    inside = terms.tfidf(frame, "id", "clean", vocabulary, 122)
    assert "Exchange hashpartitioning(id" not in inside._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(terms, "_LOOKUP_TERMS", 10)
    assert shown(inside) == shown(terms.tfidf(frame, "id", "clean", vocabulary, 122))
    lengths = {}
    for (i, _), w in shown(inside).items():
        lengths[i] = lengths.get(i, 0) + w * w
    assert np.allclose(list(lengths.values()), 1)
