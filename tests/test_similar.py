"""Campaigns of similar messages against a plain loop, over several batches."""

import random

import numpy as np
import pytest

from mailprism.operators import similar
from mailprism.operators.similar import CampaignStore, representatives, shingles, sketch
from pyspark.sql import functions as F


def text(rng, n):
    return " ".join(f"w{rng.randrange(400)}x" for _ in range(n))


def family(rng, n, words=60, changes=1):
    """Variants of one text with few words changed."""
    base = text(rng, words).split()
    for _ in range(n):
        mine = list(base)
        for _ in range(rng.randint(0, changes)):
            mine[rng.randrange(words)] = f"y{rng.randrange(1000)}z"
        yield " ".join(mine)


def plain(rows):
    """(id, text) in order of batches to {id: representative's id}."""
    def grams(t):
        w = "".join("#" if c.isdigit() else c for c in t)
        while "##" in w:
            w = w.replace("##", "#")
        w = w.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else None

    chosen, out = [], {}
    for batch in rows:
        first = {}
        for i, t in sorted(batch):
            first.setdefault(grams(t), i)
        of = {}
        for g, i in sorted(first.items(), key=lambda x: x[1]):
            if g is None:
                continue
            of[g] = next((j for h, j in chosen if len(g & h) >= 0.8 * len(g | h)), None)
            if of[g] is None:
                chosen.append((g, i))
                of[g] = i
        out |= {i: of[grams(t)] for i, t in batch if grams(t) is not None}
    return out


def batches(seed):
    rng = random.Random(seed)
    # Digits are masked, so words differ by letters as well.
    letters = lambda t: "".join(chr(97 + int(c)) if c.isdigit() else c for c in t)
    texts = [letters(t) for _ in range(8) for t in family(rng, rng.randint(1, 25), rng.randint(20, 80), rng.randint(0, 4))]
    texts += [letters(text(rng, rng.randint(1, 40))) for _ in range(40)] + ["", " ", "one two", "one two", "call 12 now", "call 345 now"]
    rng.shuffle(texts)
    rows = [(f"m{i:04}", t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    third = len(rows) // 3
    return [rows[:third], rows[third : 2 * third], rows[2 * third :]]


@pytest.mark.parametrize("seed", [1])
def test_batches_keep_their_campaigns(spark, tmp_path, seed):
    parts = batches(seed)
    store = CampaignStore(spark, f"{tmp_path}/campaigns")
    frames = [spark.createDataFrame(p, "email_id string, clean string").withColumn("node", F.lit("x")) for p in parts]
    before = {}
    for number, frame in enumerate(frames):
        store.add(frame, "email_id", "clean", number)
        now = {r.email_id: r.cluster_id for r in store.members().collect()}
        assert before.items() <= now.items()  # no id changes when a batch comes
        before = now
    want = plain(parts)
    groups = lambda found: sorted(sorted(i for i in found if found[i] == c) for c in set(found.values()))
    assert groups(before) == groups(want) and len(set(before.values())) < len(before)
    # The same batch again, as after a failure.
    store.add(frames[2], "email_id", "clean", 2)
    assert {r.email_id: r.cluster_id for r in store.members().collect()} == before
    sizes = {r.cluster_id: (r.messages, r.variations_detected) for r in store.campaigns().collect()}
    texts = {i: t for p in parts for i, t in p}
    for cluster, (n, kinds) in sizes.items():
        mine = [i for i in before if before[i] == cluster]
        assert n == len(mine) >= 2 and kinds == len({texts[i] for i in mine})
    assert store.context().count() == sum(n for n, _ in sizes.values())


def test_empty_batch_and_missing_values(spark, tmp_path):
    store = CampaignStore(spark, f"{tmp_path}/campaigns")
    rows = spark.createDataFrame([(None, "a b"), ("x", None), (None, "a b"), ("y", "")], "id string, clean string")
    assert store.add(rows.limit(0), "id", "clean", 0).count() == 0 and store.campaigns().count() == 0
    assert [r.email_id for r in store.add(rows, "id", "clean", 1).collect()] == ["", ""]
    assert [(r.messages, r.variations_detected, r.pattern) for r in store.campaigns().collect()] == [(2, 1, "a b")]


def test_large_campaign_makes_few_pairs(spark):
    """1,500 variants of one text: the pairs that are verified grow with the rows, not with their square."""
    rng = random.Random(4)
    variants = sorted({"".join(chr(97 + int(c)) if c.isdigit() else c for c in t) for t in family(rng, 1500, 100, 2)})
    rows = spark.createDataFrame([(f"n{i:05}", t) for i, t in enumerate(variants)], "node string, pattern string")
    sets = rows.withColumn("shingles", shingles("pattern")).withColumn("s", sketch("shingles")).select("node", "shingles", "s.bits", "s.bands").cache()
    asked = []
    verified = similar._verified
    try:
        similar._verified = lambda pairs, *rest: (asked.append(pairs.count()), verified(pairs, *rest))[1]
        found = representatives(sets).collect()
    finally:
        similar._verified = verified
    assert sum(asked) < 12 * len(variants) and len(found) < len(variants) / 5


def test_only_texts_that_share_a_band_are_moved(spark, monkeypatch):
    """Comparisons are given the texts that can be similar to another, not the whole batch."""
    rng = random.Random(6)
    letters = lambda t: "".join(chr(97 + int(c)) if c.isdigit() else c for c in t)
    texts = sorted({letters(t) for t in family(rng, 8, 100, 1)}) + [letters(text(rng, 60)) for _ in range(200)]
    rows = spark.createDataFrame([(f"n{i:05}", t) for i, t in enumerate(texts)], "node string, pattern string")
    sets = rows.withColumn("shingles", shingles("pattern")).withColumn("s", sketch("shingles")).select("node", "pattern", "shingles", "s.bits", "s.bands").cache()
    given, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, left, *rest: (given.append(left.count()), verified(pairs, left, *rest))[1])
    by_pattern = {r.node for r in representatives(sets).collect()}
    assert given and max(given) < 40
    assert {r.node for r in representatives(sets.drop("pattern")).collect()} == by_pattern and 201 <= len(by_pattern) < len(texts)


def test_a_batch_is_cleaned_once(spark, tmp_path):
    """Nodes and members read the same texts, and cleaning is a large part of the work."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def clean(text):
        seen.add(1)
        return text

    texts = ["one two three four five six", "one two three four five 6", "", "  ", None, "other words here"]
    rows = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "id string, text string")
    rows = rows.select("id", clean("text").alias("clean"))
    members = CampaignStore(spark, f"{tmp_path}/campaigns").add(rows, "id", "clean", 0)
    assert {r.email_id for r in members.collect()} == {"m0", "m1", "m5"} and seen.value == len(texts)


def test_estimate_rarely_loses_a_pair(spark):
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(2000):
        a = rng.integers(-(1 << 62), 1 << 62, 90)
        b = np.concatenate([a[:80], rng.integers(-(1 << 62), 1 << 62, 10)])  # 80 of 100: similarity 0.8
        with np.errstate(over="ignore"):
            (ka, ba), (kb, bb) = similar._sketch(a), similar._sketch(b)
        assert sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(ba, bb)) <= similar._unlikely(0.8)
        lost += not set(ka) & set(kb)
    assert lost <= 6


def test_stream_of_batches(spark, tmp_path):
    parts = batches(3)
    for p in parts:
        spark.createDataFrame(p, "email_id string, clean string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = CampaignStore(spark, f"{tmp_path}/campaigns")
    stream = spark.readStream.schema("email_id string, clean string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = stream.writeStream.foreachBatch(store.sink("email_id", "clean")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert running.awaitTermination(300)
    assert {r.email_id for r in store.members().collect()} == set(plain(parts))
