"""Replay of the aggregation buffer against a plain loop, ordinary and split path."""

import random

import numpy as np
import pytest

from mailprism.operators.episodes import EpisodeRules, assign_episodes, next_starts, replay_aggregation
from pyspark.sql import functions as F

RULES = EpisodeRules(timeout_ms=30, sweep_ms=5)
SCHEMA = "task_id string, analyzer_type string, ts_ms long, seq long"


def brute_force(rows, rules=RULES):
    """One task after the other, message by message."""
    out, opened = {}, {}
    for task, kind, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        state = opened.get(task)
        if state:
            deadline = state[0] + rules.timeout_ms
            sweep = deadline if not rules.sweep_ms else -(-deadline // rules.sweep_ms) * rules.sweep_ms
            if ts >= sweep:
                state = None
        if not state:
            state = opened[task] = (ts, seq, set())
        state[2].add(kind)
        closes = None
        if len(state[2]) >= rules.expected:
            closes = "complete"
        elif ts >= state[0] + rules.timeout_ms:
            closes = "partial"
        out[(task, seq)] = (state[0], state[1], closes)
        if closes:
            opened[task] = None
    return out


def random_rows(seed, tasks, n, span, kinds="abcde"):
    rng = random.Random(seed)
    return [(rng.choice(tasks), rng.choice(kinds), rng.randrange(span), i) for i in range(n)]


def labelled(df, **options):
    rows = assign_episodes(df, RULES, **options).collect()
    return {(r.task_id, r.seq): (r.opened_ms, r.opened_seq, r.closes) for r in rows}


def test_next_starts_against_brute_force():
    for seed in range(25):
        rows = [r for r in random_rows(seed, ["t"], 60, 200, "abcde"[: 3 + seed % 3])]
        rows.sort(key=lambda r: (r[2], r[3]))
        times = np.array([r[2] for r in rows])
        kinds = np.array([r[1] for r in rows])
        follow, last = next_starts(times, kinds, RULES)
        for i in range(len(rows)):
            labels = brute_force(rows[i:])
            mine = [k for k, v in labels.items() if (v[0], v[1]) == (rows[i][2], rows[i][3])]
            assert last[i] - i + 1 == len(mine)
            assert follow[i] == i + len(mine)


@pytest.mark.parametrize("seed, span", [(1, 300), (2, 3_000)])
def test_plain_and_split_paths(spark, seed, span):
    rows = random_rows(seed, ["hot"] * 20 + [f"t{i}" for i in range(10)], 700, span)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_force(rows)
    assert labelled(df) == want
    assert labelled(df, split_rows=100, reaches_per_block=2) == want
    assert labelled(df, split_rows=0, reaches_per_block=3) == want


def test_blocks_go_to_python_many_at_a_time(spark):
    """One call for each block of a task took longer than the work in it; a block may lie in several batches."""
    rows = random_rows(3, [f"t{i}" for i in range(40)] + ["hot"] * 20, 2_000, 3_000)
    df = spark.createDataFrame(rows, SCHEMA)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        split = assign_episodes(df, RULES, split_rows=0, reaches_per_block=2)
        assert "FlatMapGroups" not in split._jdf.queryExecution().executedPlan().toString()
        found = {(r.task_id, r.seq): (r.opened_ms, r.opened_seq, r.closes) for r in split.collect()}
    finally:
        spark.conf.set(key, before)
    assert found == brute_force(rows)


def test_tasks_stay_whole_behind_a_join(spark, tmp_path, monkeypatch):
    """A join on the task that turns out small reads its input in other parts, so rows are dealt anew behind it."""
    from mailprism.operators import episodes

    monkeypatch.setattr(episodes, "_BROADCAST_TASKS", 0)
    rows = random_rows(5, [f"t{i}" for i in range(50)] + ["hot"] * 20, 3_000, 3_000)
    spark.createDataFrame(rows, SCHEMA).repartition(8).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "8192")  # known to be small only when it runs
    try:
        assert labelled(df, split_rows=500, reaches_per_block=2) == brute_force(rows)
    finally:
        spark.conf.unset(key)


def test_replay_cases(spark):
    def message(task, kind, ts, seq, at="x", score=0.5):
        return (task, kind, score, "{}", "r", at, ts, seq)

    rows = [
        # complete inside the deadline, with one exact duplicate
        *[message("full", k, i, i) for i, k in enumerate(["text", "html", "images"])],
        message("full", "html", 4, 4),
        message("full", "links-meta", 5, 5),
        # same type, new stamp: five results averaged
        message("five", "text", 0, 0), message("five", "text", 1, 1, at="y"),
        *[message("five", k, 2, 2 + i) for i, k in enumerate(["html", "images", "links-meta"])],
        # three types only
        *[message("late", k, 1, i) for i, k in enumerate(["text", "html", "images"])],
        # fourth message after the deadline 31, before the sweep 35
        *[message("edge", k, 1, i) for i, k in enumerate(["text", "html"])],
        message("edge", "text", 32, 3, at="z"),
        # fifth message after completion opens a buffer that times out
        *[message("more", k, 1, i) for i, k in enumerate(["text", "html", "images", "links-meta", "text"])],
    ]
    df = spark.createDataFrame(
        rows,
        "task_id string, analyzer_type string, score double, features string, reason string, "
        "analyzed_at string, ts_ms long, seq long",
    )
    got = {
        (r.task_id, r.opened_seq): (r.status, r.n_results, None if r.results is None else [x.analyzer_type for x in r.results])
        for r in replay_aggregation(df, RULES).collect()
    }
    assert got == {
        ("full", 0): ("complete", 4, ["text", "html", "images", "links-meta"]),
        ("five", 0): ("complete", 5, ["text", "text", "html", "images", "links-meta"]),
        ("late", 0): ("timeout", 3, None),
        ("edge", 0): ("partial", 3, ["text", "html", "text"]),
        ("more", 0): ("complete", 4, ["text", "html", "images", "links-meta"]),
        ("more", 4): ("timeout", 1, None),
    }


@pytest.mark.parametrize("split_rows", [2_000_000, 0])
def test_equal_numbers_in_four_topics(spark, split_rows):
    """Messages of one stamp and number, as four topics may bring them, stay four rows."""
    rows = [("t", kind, ts, 7) for ts in (1, 100) for kind in ("text", "html", "images", "links-meta")] + [("t", "text", 300, 7)] * 2
    found = assign_episodes(spark.createDataFrame(rows, SCHEMA), RULES, split_rows=split_rows, reaches_per_block=1).collect()
    assert sorted((r.ts_ms, r.analyzer_type, r.opened_ms, r.closes) for r in found if r.closes) == [
        (1, "text", 1, "complete"), (100, "text", 100, "complete"),
    ]
    assert len(found) == len(rows) and sum(r.ts_ms == 300 for r in found) == 2


def test_sequence_numbers_differ(spark):
    from mailprism.sources.bus import sequence_number

    rows = [(t, p, o) for t in "abcd" for p in (0, 1, 4095, 4096, 262_143) for o in (0, 1, 4096, 500_000_000_000)]
    frame = spark.createDataFrame(rows, "topic string, partition int, offset long")
    numbers = [r.n for r in frame.select(sequence_number(list("abcd")).alias("n")).collect()]
    assert len(set(numbers)) == len(rows) and min(numbers) >= 0
    ordered = frame.filter("topic = 'b' and partition = 4096").orderBy("offset").select(sequence_number(list("abcd")).alias("n"))
    assert [r.n for r in ordered.collect()] == sorted(r.n for r in ordered.collect())
    with pytest.raises(Exception, match="beyond the sequence number"):
        spark.createDataFrame([("a", 1 << 18, 0)], frame.schema).select(sequence_number(["a"]).alias("n")).collect()
    with pytest.raises(ValueError):
        sequence_number([])


def test_open_episodes_gather_nothing(spark):
    """Results of an episode that times out are counted, not gathered."""
    rows = [("hot", "abc"[i % 3], float(i), "{}", "r", str(i), i % 25, i) for i in range(3_000)]
    frame = spark.createDataFrame(
        rows, "task_id string, analyzer_type string, score double, features string, reason string, analyzed_at string, ts_ms long, seq long"
    )
    (row,) = replay_aggregation(frame, RULES).collect()
    assert (row.status, row.n_results, row.results) == ("timeout", 3_000, None)
