"""Mixing, top-k and the whole pipeline."""

import collections
import math
import random
import re

import corpus_pipeline
from fixtures import plain

from mailprism.llm import mixing
from mailprism.llm.common import word_count, written
from mailprism.llm.mixing import fit_lengths, mix_documents, mixed_corpus, targets
from mailprism.llm.top_k import top_k

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets_share_what_is_left():
    got = targets([("b", 100), ("a", 10), (None, 50)])
    # a, b, NULL weigh 3, 1, 2; a stops at 20, the rest is shared 1 : 2, NULL stops at 100.
    assert got == {"a": 20.0, None: 100.0, "b": 120.0}
    assert targets([("a", 0)]) == {"a": 0.0} and targets([]) == {}


def test_lengths_fit_exactly_where_they_can():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}
        total = sum(a * b for a, b in counts.items())
        budget = rng.randint(0, total + 5)
        chosen = fit_lengths(budget, counts)
        assert all(0 < n <= counts[length] for length, n in chosen.items())
        assert sum(a * b for a, b in chosen.items()) <= budget
    assert fit_lengths(1000, {3: 200, 5: 400, 7: 2}) and sum(a * b for a, b in fit_lengths(1000, {3: 200, 5: 400, 7: 2}).items()) == 1000


def test_mix(documents):
    rows = documents.select("doc_id", "text", "source").collect()
    got = mix_documents(documents).collect()
    sizes, longest = collections.Counter(), collections.Counter()
    for r in rows:
        words = len(WORD.findall(r.text or ""))
        sizes[r.source] += words
        longest[r.source] = max(longest[r.source], words)
    want = targets(list(sizes.items()))
    assert plain((r.doc_id, r.size) for r in got) == plain((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
    taken = collections.Counter()
    for r in got:
        assert r.taken == 0 or (r.size and r.taken % r.size == 0 and r.taken <= 2 * r.size)
        taken[r.source_size, round(r.target, 6)] += r.taken
    for source, size in sizes.items():
        assert abs(taken[size, round(want[source], 6)] - want[source]) <= (longest[source] if longest[source] > size / 2 else 0.02 * size)
    assert plain(mix_documents(documents.repartition(2)).collect()) == plain(got)
    mix = mixed_corpus(documents)
    assert mix.dtypes == documents.dtypes
    assert sum(len(WORD.findall(r.text or "")) for r in mix.collect()) == sum(r.taken for r in got)
    assert mix_documents(documents.limit(0)).count() == 0 and mixed_corpus(documents.limit(0)).count() == 0


def test_many_cuts_are_not_broadcast(documents, monkeypatch):
    """A written table of more rows than may be broadcast is joined by a merge, however small its file."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = lambda df, label: (plans.append((label, plan(df))), written(df, label))[1]
    monkeypatch.setattr(mixing, "written", kept)
    want = plain(mix_documents(documents).collect())
    few = dict(plans)
    assert few["cuts"].count("BroadcastHashJoin") == 0 and few["drawn"].count("BroadcastHashJoin") == 2
    monkeypatch.setattr(mixing, "BROADCAST_CUTS", 0)
    mixed = mix_documents(documents)
    many = dict(plans)
    # What is left is the list of sources.
    assert many["drawn"].count("BroadcastHashJoin") == 1 and plan(mixed).count("BroadcastHashJoin") == 1
    assert plain(mixed.collect()) == want


def test_word_count(corpus):
    texts = [None, "", " ", "a", " a  b\t\nc ", "\x0b\x0c", "é  x", "a" * 100_000]
    frame = corpus.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in frame.select(word_count(frame.t).alias("n")).collect()] == [len(WORD.findall(t or "")) for t in texts]


def best(rows, k, every):
    whole = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for i, e in {(i, tuple(e)) for i, e in whole if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in whole if j != i and len(f) == len(e))[:k]
        yield from ((i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1))


def test_top_k(corpus):
    rng = random.Random(1)
    same = [1.0, 2.0, -0.5]
    kinds = [
        lambda: same, lambda: [rng.gauss(0, 1) for _ in range(3)], lambda: [float(rng.randint(-2, 2))] * 3, lambda: [0.5], lambda: [],
        lambda: None, lambda: [1.0, None], lambda: [float("nan"), 1.0, 2.0], lambda: [1e5, -1e5, 3e4], lambda: [float("inf"), 0.0, 0.0],
    ]
    rows = [(rng.choice([i, i, i // 3 * 3, None, -i]), rng.choice(kinds)()) for i in range(400)]
    rows += [(5000 + i, same) for i in range(300)] + rows[:20]
    frame = corpus.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as q", "2 as vector").repartition(4)
    got = top_k(corpus, frame, every=20, block_queries=64).collect()
    assert plain(got) == plain(best(rows, 10, 20))
    assert top_k(corpus, frame.limit(0)).count() == 0


def test_pipeline_stages(corpus):
    folder = "/root/testdata/sf0.001"
    docs = corpus.read.parquet(f"{folder}/documents.parquet")
    schema, counts, seen = docs.schema, [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(corpus, docs, folder), "stage")
        counts.append(docs.count())
        seen.append(docs)
        assert name == "packing" or docs.schema == schema
    quality, dedup, secrets, mix, packed = seen
    ids = lambda frame: collections.Counter(r.doc_id for r in frame.select("doc_id").collect())
    assert ids(dedup) == ids(secrets) and set(ids(dedup)) <= set(ids(quality)) and set(ids(mix)) <= set(ids(dedup))
    assert max(ids(dedup).values()) == 1 and max(ids(mix).values()) <= 2
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids(mix))
    assert counts[-1] == corpus_pipeline.run(corpus, folder).count()
