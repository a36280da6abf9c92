"""Streams: same results as batch, timeouts in processing time, dead letters, sinks."""

import json
import time

import numpy as np
import pytest

from mailprism import schemas
from mailprism.operators.episodes import EpisodeRules, replay_aggregation
from mailprism.operators.verdicts import decide
from mailprism.sources import bus
from mailprism.sources.verdict_table import missing, parquet_target, with_digest, write_verdicts
from mailprism.streaming import flow
from mailprism.streaming.aggregate import aggregate_stream, aggregates_of
from pyspark.sql import functions as F

RESULTS = (
    "task_id string, analyzer_type string, score double, features string, reason string, analyzed_at string, "
    "ts_ms long, seq long"
)


def message(task, kind, ts, seq, score=0.5, at="x"):
    return (task, kind, score, "{}", "r", at, ts, seq)


def write_files(spark, folder, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in order of their modification time


def test_event_time_stream_equals_batch_replay(spark, tmp_path):
    import random

    rng = random.Random(11)
    rules = EpisodeRules(timeout_ms=30_000, sweep_ms=5_000)
    rows = sorted(
        (message(f"t{rng.randrange(8)}", rng.choice("abcde"), rng.randrange(600_000), i, rng.random()) for i in range(300)),
        key=lambda r: (r[6], r[7]),
    )
    rows = [(*r[:6], r[6], i) for i, r in enumerate(rows)]
    end = message("end", "a", 10_000_000, 10_000)
    write_files(spark, tmp_path, [rows[:100], rows[100:200], rows[200:], [end]], RESULTS)
    stream = (
        spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        .withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "0 seconds")
    )
    running = (
        aggregate_stream(stream, rules, event_time="at").writeStream.format("parquet")
        .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    assert running.awaitTermination(120)
    shape = lambda df: sorted(
        (r.task_id, r.opened_ms, r.status, r.n_results, None if r.results is None else [(x.analyzer_type, x.score) for x in r.results])
        for r in df.collect() if r.task_id != "end"
    )
    batch = replay_aggregation(spark.createDataFrame(rows, RESULTS), rules)
    assert shape(spark.read.parquet(f"{tmp_path}/out")) == shape(batch)


def closed_in_batches(spark, folder, parts, rules, **options):
    """Rows that the stream gives for parts that come one after the other, an end behind them."""
    write_files(spark, folder, [*parts, [message("end", "a", 10_000_000, 10_000_000)]], RESULTS)
    stream = (
        spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        .withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", "100 seconds")
    )
    running = (
        aggregate_stream(stream, rules, event_time="at", **options).writeStream.format("parquet")
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    assert running.awaitTermination(180)
    return [r for r in spark.read.parquet(f"{folder}/out").collect() if r.task_id != "end"]


def told(rows):
    return sorted(
        (r.task_id, r.opened_ms, r.last_ms, r.status, r.n_results, None if r.results is None else [(x.analyzer_type, x.score) for x in r.results])
        for r in rows
    )


def test_batches_out_of_order_equal_replay(spark, tmp_path):
    import random

    rng = random.Random(23)
    rules = EpisodeRules(timeout_ms=30_000, sweep_ms=5_000)
    rows = [message(f"t{rng.randrange(6)}", rng.choice("abcde"), (1_000 + rng.randrange(400)) * 1_000, i, rng.random()) for i in range(400)]
    rows += [(*r[:6], r[6] + rng.randrange(3) * 1_000, 1_000 + i) for i, r in enumerate(rows[::5])]  # copies, some in the same buffer
    # A row comes up to 90 seconds too late, so younger ones of its task are there before it.
    late = sorted(rows, key=lambda r: r[6] + rng.randrange(90_000))
    parts = [late[at : at + 120] for at in range(0, len(late), 120)]
    assert any(min(r[6] for r in b) < max(r[6] for r in a) for a, b in zip(parts, parts[1:]))
    got = closed_in_batches(spark, tmp_path, parts, rules)
    assert told(got) == told(replay_aggregation(spark.createDataFrame(rows, RESULTS), rules).collect())
    assert {r.status for r in got} == {"complete", "partial", "timeout"}


def test_large_task_has_bounded_state(spark, tmp_path):
    """20,000 results of three kinds, half of them copies, then the fourth kind; and the same without it."""
    from mailprism.streaming import aggregate

    rules = EpisodeRules(timeout_ms=300_000, sweep_ms=0)
    many = [message(task, "abc"[i % 3], i // 2, i, float(i // 6), at=str(i // 6)) for task in ("full", "open") for i in range(20_000)]
    got = closed_in_batches(spark, tmp_path, [many[1::2], [*many[::2], message("full", "d", 250_000, 20_000)]], rules)
    assert sorted((r.task_id, r.status, r.n_results) for r in got) == [("full", "complete", 10_002), ("open", "timeout", 10_001)]
    results = next(r.results for r in got if r.status == "complete")
    assert [x.score for x in results[:-1]] == sorted(x.score for x in results[:-1]) and results[-1].analyzer_type == "d"
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 1).load(f"{tmp_path}/state")
    value = next(c for c in ("user_map_value", "value") if c in waiting.columns)
    sizes = waiting.selectExpr(f"size({value}.ts_ms) as n").collect()
    assert sizes and max(r.n for r in sizes) <= aggregate.RUN_ROWS


def test_many_tasks_share_the_keys_of_the_state(spark, tmp_path):
    """A call to the state serves many tasks: 3,000 tasks that wait do not make 3,000 keys."""
    import random

    rng = random.Random(31)
    rules = EpisodeRules(timeout_ms=30_000, sweep_ms=5_000)
    rows = [message(f"t{i % 3_000}", rng.choice("abcde"), (1_000 + rng.randrange(90)) * 1_000, i, rng.random()) for i in range(9_000)]
    got = closed_in_batches(spark, tmp_path, [rows[:4_500], rows[4_500:]], rules)
    assert told(got) == told(replay_aggregation(spark.createDataFrame(rows, RESULTS), rules).collect())
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("batchId", 1).load(f"{tmp_path}/state")
    assert 0 < waiting.select("key").distinct().count() <= 1_024


def test_few_shards_equal_replay(spark, tmp_path):
    """Waiting, open and stored results of 400 tasks in two shards; the task without id is one of them."""
    import random
    from types import SimpleNamespace

    from mailprism.streaming import aggregate

    rng = random.Random(37)
    rules = EpisodeRules(timeout_ms=120_000, sweep_ms=5_000)
    tasks = [*(f"t{i}" for i in range(400)), "none"]
    rows = [message(rng.choice(tasks), rng.choice("abcde"), (1_000 + rng.randrange(400)) * 1_000, i, rng.random()) for i in range(2_500)]
    # Tasks with more results at a time than stay beside the figures, copies among them; one completes.
    rows += [
        message(f"h{i % 4}", rng.choice("abc"), (1_000 + rng.randrange(400)) * 1_000, 10_000 + i, rng.randrange(200) / 200) for i in range(2_500)
    ]
    rows += [message("h0", "d", at * 1_000, 20_000 + at) for at in (1_100, 1_300)]
    late = sorted(rows, key=lambda r: r[6] + rng.randrange(90_000))
    parts = [[(None if r[0] == "none" else r[0], *r[1:]) for r in late[at : at + 1_700]] for at in range(0, len(late), 1_700)]
    got = closed_in_batches(spark, tmp_path, parts, rules, shards=2)
    got = [SimpleNamespace(**r.asDict() | {"task_id": "none" if r.task_id is None else r.task_id}) for r in got]
    want = told(replay_aggregation(spark.createDataFrame(rows, RESULTS), rules).collect())
    assert told(got) == want
    assert {r[3] for r in want} == {"complete", "partial", "timeout"} and any(r[0] == "none" for r in want)
    assert max(r[4] for r in want if r[3] == "complete") > aggregate.INLINE_ITEMS
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).option("batchId", 2).load(f"{tmp_path}/state")
    chunks = state("chunks").selectExpr("size(user_map_value.tasks) as n", "size(flatten(user_map_value.newest)) as items").collect()
    assert len(chunks) > 2 and max(r.n for r in chunks) <= aggregate.CHUNK_TASKS
    assert max(r["items"] for r in chunks) <= aggregate.RUN_ROWS
    assert state("items").count() > 0


def test_tombstone_swallows_a_further_result(spark, tmp_path):
    rules = EpisodeRules(timeout_ms=30_000, sweep_ms=5_000)
    full = [message("a", k, 1_000 + i, i) for i, k in enumerate(["text", "html", "images", "links-meta"])]
    further = [message("a", "text", 5_000, 5, at="y"), message("a", "html", 62_000, 6, at="z")]
    keep = lambda rows: [(r.opened_ms, r.status, r.n_results) for r in sorted(rows, key=lambda r: r.opened_ms)]
    got = closed_in_batches(spark, tmp_path / "with", [full, further], rules, tombstone_ms=60_000)
    assert keep(got) == [(1_000, "complete", 4), (62_000, "timeout", 1)]
    got = closed_in_batches(spark, tmp_path / "without", [full, further], rules)
    assert keep(got) == [(1_000, "complete", 4), (5_000, "timeout", 1), (62_000, "timeout", 1)]


def test_processing_time_timeout(spark, tmp_path):
    full = [message("full", k, 0, i) for i, k in enumerate(["text", "html", "images", "links-meta"])]
    full.append(full[0])
    short = [message("short", k, 0, i) for i, k in enumerate(["text", "html"])]
    write_files(spark, tmp_path, [full + short], RESULTS)
    stream = spark.readStream.schema(RESULTS).parquet(f"{tmp_path}/in")
    running = (
        aggregate_stream(stream, EpisodeRules(timeout_ms=3_000)).writeStream.format("memory").queryName("closed")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("closed").count() < 2:
            time.sleep(1)
    finally:
        running.stop()
    got = {r.task_id: (r.status, r.n_results) for r in spark.table("closed").collect()}
    assert got == {"full": ("complete", 4), "short": ("timeout", 2)}


def test_raw_tasks_to_verdict_table(spark, tmp_path):
    texts = [
        json.dumps({"task_id": "a", "text": "urgent verify password account confirm", "html": '<p class="p-1"><form>'}),
        json.dumps({"task_id": "b", "text_part": "hello there"}),
        "{bad", "[1]", json.dumps({"text": "no id"}),
    ]
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.parquet(f"{tmp_path}/in")
    messages = spark.readStream.schema("value string").parquet(f"{tmp_path}/in")
    from mailprism.plans.scoring import score_messages

    verdicts = flow.verdict_stream(score_messages(flow.task_stream(messages)))
    target = parquet_target(f"{tmp_path}/table")
    running = write_verdicts(verdicts, target, f"{tmp_path}/state", availableNow=True)
    assert running.awaitTermination(120)
    rows = {r.email_id: r for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert {k: (v.overall_risk, v.ai_assistance_score) for k, v in rows.items()} == {
        "a": ("PROBABLY_HUMAN", 0.388), "b": ("DEFINITELY_HUMAN", 0.0),
    }
    blob = json.loads(rows["a"].full_verdict)
    assert blob["individual_scores"] == [1.0, 0.55, 0.0, 0.0] and len(blob["reasons"]) == 4
    # The same batch again, as after a failure, replaces its rows.
    before = spark.read.parquet(f"{tmp_path}/table").count()
    decided = decide(spark.createDataFrame([("a", [("text", 1.0, "{}", "r", "t")])], "task_id string, results array<struct<analyzer_type:string,score:double,features:string,reason:string,analyzed_at:string>>"))
    from mailprism.operators.verdicts import to_verdict_row

    for _ in range(2):
        target(to_verdict_row(decided), 7)
    assert spark.read.parquet(f"{tmp_path}/table").count() == before + 1


def test_results_through_messages(spark):
    rows = [
        ('{"task_id": "a", "score": 0.9, "features": {"k": 1}}', "analysis.links-meta"),
        ('{"task_id": "", "score": 0.9}', "analysis.text"),
        ('{"task_id": "a", "analyzer_type": "text", "score": 0.1, "reason": "r"}', "analysis.text"),
        ("{bad", "analysis.html"), ("[1]", "analysis.html"), ('"text"', "analysis.html"), ("", "analysis.html"),
        ('{"task_id": "a"} x', "analysis.html"), ('{"task_id": "a"},{"task_id": "b"}', "analysis.html"),
        ('{"task_id": "a", "score": "high"}', "analysis.html"),
    ]
    frame = spark.createDataFrame([(v.encode(), t, i) for i, (v, t) in enumerate(rows)], "value binary, topic string, seq long")
    frame = frame.withColumn("timestamp", F.timestamp_millis(F.lit(5)))
    accepted, dead = flow.result_stream(frame)
    assert [(r.task_id, r.analyzer_type, r.score, r.ts_ms) for r in accepted.orderBy("seq").collect()] == [
        ("a", "links-meta", 0.9, 5), ("a", "text", 0.1, 5),
    ]
    letters = dead.collect()
    assert len(letters) == 7 and {x.raw for x in letters} >= {"{bad", "[1]"} and all(x.task_id is None for x in letters)


def test_invalid_utf8_goes_to_dead_letters(spark):
    frame = spark.createDataFrame([(bytearray(b'{"task_id": "a\xff"}'), "t")], "value binary, topic string")
    from mailprism.operators.results import decode_messages, split_dlq

    valid, dead = split_dlq(decode_messages(frame, schemas.RESULT))
    assert valid.count() == 0 and "�" in dead.collect()[0].raw


def test_messages_out(spark):
    frame = spark.createDataFrame([("a", None)], "task_id string, reason string")
    row = bus.as_messages(frame).collect()[0]
    assert row.key == "a" and json.loads(row.value) == {"task_id": "a", "reason": None}


def test_aggregates_of(spark):
    frame = spark.createDataFrame([("a", "complete", 0, 5, 1, None), ("b", "timeout", 0, 5, 1, None)], "task_id string, status string, opened_ms long, last_ms long, n_results int, results array<string>")
    assert [r.task_id for r in aggregates_of(frame).collect()] == ["a"]


def test_a_repeated_batch_writes_what_is_missing(spark):
    rows = with_digest(spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":2}')], "email_id string, full_verdict string"))
    done = rows.filter("email_id = 'a'").selectExpr("email_id as done_id", "digest as done_digest")
    assert [r.email_id for r in missing(rows, done).collect()] == ["b"]
    assert missing(rows, rows.selectExpr("email_id as done_id", "digest as done_digest")).count() == 0


def test_model_and_domains_reach_stream_and_batch_alike(spark, tmp_path):
    from mailprism.plans.scoring import score_messages
    from mailprism.streaming.flow import task_stream

    def model():
        return lambda texts: np.array([[0.0, len(t) / 10.0] for t in texts])

    page = '<a href="http://bad.example/x">x</a>'
    tasks = [("1", "hello there", page), ("2", "a longer text of words", None)]
    frame = spark.createDataFrame(tasks, "task_id string, text string, html string")
    frame.selectExpr("to_json(struct(task_id, text, html)) as value").write.parquet(f"{tmp_path}/in")
    options = {"make_predict": model, "domains": ["BAD.example"]}
    at = F.lit("2024-02-01")
    batch = score_messages(frame, at, **options).select("task_id", F.to_json("results").alias("r"))
    source = spark.readStream.schema("value string").parquet(f"{tmp_path}/in")
    stream = score_messages(task_stream(source), at, **options).select("task_id", F.to_json("results").alias("r"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(
        availableNow=True
    ).start().awaitTermination()
    want = sorted(tuple(r) for r in batch.collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    assert '"suspicious_links\\":1' in want[0][1] and '"score":0.7503' in want[0][1]


def test_status_moves_with_the_watermark(spark, tmp_path):
    from mailprism.streaming.status import current_status, status_stream

    stamp = lambda c: F.timestamp_millis(F.col(c) * 1000)
    for name, parts, schema in (
        ("tasks", [[("a", 10), ("b", 20), ("c", 30)], [("d", 500)], [("end", 100_000)]], "task_id string, t long"),
        ("verdicts", [[("a", 40, "MIXED", 0.5), ("x", 41, "MIXED", 0.5)], [("a", 60, "PROBABLY_AI", 0.7), ("b", 300, "MIXED", 0.4)], [("end", 100_000, "", 0.0)]],
         "task_id string, t long, verdict string, score double"),
    ):
        write_files(spark, f"{tmp_path}/{name}", parts, schema)

    def read(name, schema, column):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
        return rows.withColumn(column, stamp("t")).drop("t").withWatermark(column, "1000 seconds")

    changes = status_stream(read("tasks", "task_id string, t long", "created_at"),
                            read("verdicts", "task_id string, t long, verdict string, score double", "decided_at"), 100)
    running = (
        changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True).start()
    )
    assert running.awaitTermination(180)
    found = spark.read.parquet(f"{tmp_path}/out").filter("task_id <> 'end'")
    log = sorted((r.task_id, r.status, r.verdict, int(r.at.timestamp())) for r in found.select("task_id", "status", "verdict", "at").collect())
    assert log == [
        ("a", "done", "MIXED", 40), ("a", "done", "PROBABLY_AI", 60), ("a", "processing", None, 10),
        ("b", "expired", None, 120), ("b", "processing", None, 20), ("c", "expired", None, 130), ("c", "processing", None, 30),
        ("d", "expired", None, 600), ("d", "processing", None, 500),
    ]
    now = lambda t: {r.task_id: (r.status, r.verdict) for r in current_status(found, F.timestamp_millis(F.lit(t * 1000)), 100).collect()}
    assert now(100) == {"a": ("done", "PROBABLY_AI"), "b": ("processing", None), "c": ("processing", None), "d": ("processing", None)}
    assert now(125) == {"a": ("expired", None), "b": ("expired", None), "c": ("processing", None), "d": ("processing", None)}


def test_results_become_rows_and_scoring_is_not_repeated(spark):
    from mailprism.plans.scoring import result_rows

    ids = spark.range(4).withColumn("k", F.col("id").cast("string"))
    kinds = [F.struct(F.lit(kind).alias("analyzer_type"), F.upper(F.concat("k", F.lit("x"))).alias("reason")) for kind in ("text", "html")]
    scored = ids.select(F.col("k").alias("task_id"), F.array(*kinds).alias("results"))
    rows = result_rows(scored)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 2
    assert sorted(map(tuple, rows.collect())) == [(f"{i}", kind, f"{i}X") for i in range(4) for kind in ("html", "text")]
    some = [("1", [("text", "r")]), ("2", []), ("3", None)]
    some = spark.createDataFrame(some, "task_id string, results array<struct<analyzer_type string, reason string>>")
    assert [tuple(r) for r in result_rows(some).collect()] == [("1", "text", "r")]


@pytest.mark.parametrize("files", [1, 3])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, files):
    from mailprism.catalog.queries import _run_stream, _stream_table

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    rows.repartition(files).write.parquet(f"{tmp_path}/all")
    if files == 1:
        next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    else:
        (tmp_path / "all").rename(tmp_path / "documents.parquet")
    out = _run_stream(spark, _stream_table(spark, str(tmp_path), "documents"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(9))
