"""What a query does to a row, or holds at once, does not grow with the table."""

import base64
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from mailprism.functions import image as I
from mailprism.functions import text as X
from mailprism.operators import expand, terms
from mailprism.operators.expand import expand_corpus
from pyspark.sql import functions as F


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payload_steps_are_computed_once(spark):
    raw = ["plain", "", "x" * 100]
    rows = [(i, "data:text/plain;base64," + base64.b64encode(t.encode()).decode()) for i, t in enumerate(raw)]
    rows += [(3, "QUJ\nD"), (4, "QUJDR"), (5, None)]
    frame = spark.createDataFrame(rows, "id long, v string")
    decoded = frame.select("id", I.decode_image_payload("v", F.lit(None).cast("string")).alias("p"))
    assert _optimized(decoded).count("regexp_replace(") == 1
    got = {r.id: None if r.p is None else bytes(r.p) for r in decoded.collect()}
    assert got == {0: b"plain", 1: b"", 2: b"x" * 100, 3: b"ABC", 4: None, 5: b""}


def test_unstable_characters_are_those_beyond_the_stable_ones(spark):
    stable = [*range(0x80), *range(0xC0, 0x100), *range(0x400, 0x460), 0xA1, 0xAB, 0xBB, 0xBF, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x20AC]
    points = [*range(1, 0x26), *range(0x27, 0x3000), 0xFB01, 0xFF21, 0x1D400, 0x1F600]
    rows = spark.createDataFrame([(p, f"a{chr(p)}я") for p in points], "p int, t string")
    assert {r.p for r in rows.filter(X._needs_unicode(F.col("t"))).collect()} == set(points) - set(stable)


def test_long_text_is_checked_in_short_time(spark):
    """The union of all stable characters took some 1,500 nanoseconds a character."""
    rows = spark.range(8).select(F.repeat(F.lit("слово word über "), 500_000).alias("t"))
    begun = time.monotonic()
    assert rows.filter(F.rlike("t", F.lit(X._UNSTABLE))).count() == 0
    assert time.monotonic() - begun < 20


def test_expanded_corpus_has_tasks_by_bytes(spark, monkeypatch):
    rows = [(i % 90, f"Some words of seed {i % 50}, long enough!  ", 0, "human", i % 2) for i in range(100)]
    seeds = spark.createDataFrame(rows, "doc_id long, text string, label int, source string, ai_assisted int")
    few = expand_corpus(seeds, "doc_id")
    monkeypatch.setattr(expand, "TASK_BYTES", 4_000)
    tasks = expand.growing_tasks(seeds)
    many = expand_corpus(seeds, "doc_id")
    assert tasks > 20 and many.rdd.getNumPartitions() == tasks
    assert [tuple(r) for r in many.collect()] == [tuple(r) for r in few.collect()]
    texts = [r.text.strip() for r in many.collect()]
    assert len(texts) == len(set(texts)) > 100


def test_terms_of_a_batch_come_in_the_order_of_documents_and_terms():
    """Only chosen counters are counted; a NULL list has no terms."""
    grams = pa.array([["d", "b", "a", "b"], None, ["a", "c", "a"]], pa.list_(pa.string()))
    places = pa.array([[3, 1, 0, 1], None, [0, 2, 0]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([grams, places], ["grams", "places"])
    (out,) = terms._chosen_terms(SimpleNamespace(value=np.array([0, 1, 2])), 2)([batch])
    assert out.to_pylist() == [{"term": "a", "tf": 3, "df": 2}, {"term": "b", "tf": 2, "df": 1}, {"term": "c", "tf": 1, "df": 1}]
    (none,) = terms._chosen_terms(SimpleNamespace(value=np.array([], np.int64)), 2)([batch])
    assert none.num_rows == 0
