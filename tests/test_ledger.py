"""Several sinks of one batch: each gets it once, whatever breaks between them."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mailprism.sources.ledger import SinkLedger, decided, write_sinks
from mailprism.sources.verdict_table import parquet_target


def broken_once(target, before):
    """Fails at its first call, before or after the rows are written."""
    calls = []

    def write(rows, batch_id):
        calls.append(batch_id)
        if before and len(calls) == 1:
            raise RuntimeError("lost")
        target(rows, batch_id)
        if len(calls) == 1:
            raise RuntimeError("lost")

    return write, calls


def counted(target):
    calls = []

    def write(rows, batch_id):
        calls.append(batch_id)
        target(rows, batch_id)

    return write, calls


@pytest.mark.parametrize("before", [True, False])
def test_a_break_between_sinks(spark, tmp_path, before):
    def message(task, scores):
        results = [{"analyzer_type": k, "score": s, "reason": "r", "features": {}} for k, s in scores]
        return json.dumps({"task_id": task, "status": "complete", "results": results})

    kinds = ["text", "html", "images", "links-meta"]
    values = [message(f"t{i}", [(k, 0.2 * i) for k in kinds]) for i in range(4)] + ["no json"]
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    out = lambda name: str(tmp_path / name)
    add = lambda rows: spark.createDataFrame([(v, "topic") for v in rows], "value string, topic string").coalesce(1).write.mode("append").parquet(source)
    add(values)

    def stamped(batch):
        drawn = decided(batch)
        drawn["again"] = drawn["aggregates"] = drawn["aggregates"].withColumn("draw", F.uuid())
        return drawn

    first, first_calls = counted(parquet_target(out("aggregates")))
    second, second_calls = broken_once(parquet_target(out("verdicts")), before)
    targets = {"aggregates": first, "verdicts": second, "dead_letters": parquet_target(out("dead"))}

    def run():
        stream = spark.readStream.schema("value string, topic string").parquet(source)
        write_sinks(stream, stamped, targets, checkpoint, availableNow=True).awaitTermination()

    with pytest.raises(StreamingQueryException):
        run()
    drawn = {r.task_id: r.draw for r in spark.read.parquet(out("aggregates")).collect()}
    assert len(drawn) == 4 and not (tmp_path / "dead").exists()
    run()
    assert first_calls == [0] and second_calls == [0, 0]
    add([values[0].replace("t0", "t9"), "[]"])
    run()
    run()
    assert first_calls == [0, 1] and second_calls == [0, 0, 1]
    tasks = sorted([*drawn, "t9"])
    aggregates = spark.read.parquet(out("aggregates")).collect()
    assert sorted(r.task_id for r in aggregates) == tasks
    assert drawn.items() <= {r.task_id: r.draw for r in aggregates}.items()
    assert sorted(r.email_id for r in spark.read.parquet(out("verdicts")).collect()) == tasks
    assert sorted(r.raw for r in spark.read.parquet(out("dead")).collect()) == ["[]", "no json"]


def test_sinks_get_the_rows_that_were_staged(spark, tmp_path):
    ledger = SinkLedger(spark, str(tmp_path / "sinks"))
    batch = spark.range(50)
    seen = {}

    def keep(name, fail=False):
        def write(rows, batch_id):
            if fail:
                raise RuntimeError("lost")
            seen.setdefault((name, batch_id), []).append({r.id: r.draw for r in rows.collect()})

        return write

    outputs = lambda b: dict.fromkeys(("a", "b"), b.withColumn("draw", F.lit(1)))
    fresh = lambda b: dict.fromkeys(("a", "b"), b.withColumn("draw", F.lit(2)))
    assert ledger.last("a") == -1
    for number in range(4):
        with pytest.raises(RuntimeError):
            ledger.write(batch, number, outputs, {"a": keep("a"), "b": keep("b", fail=True)})
        assert (ledger.last("a"), ledger.last("b")) == (number, number - 1)
        ledger.write(batch, number, fresh, {"a": keep("a"), "b": keep("b")})
        ledger.write(batch, number, fresh, {"a": keep("a"), "b": keep("b")})
        assert seen[("a", number)] == seen[("b", number)] == [dict.fromkeys(range(50), 1)]
    assert sorted(p.name for p in (tmp_path / "sinks" / "staged").iterdir()) == ["0", "1"]
    with pytest.raises(ValueError, match="no output for c"):
        ledger.write(batch, 9, outputs, {"c": keep("c")})
    with pytest.raises(ValueError):
        ledger.write(batch, 9, outputs, {"staged": keep("staged")})
