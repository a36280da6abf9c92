"""One micro-batch written to several sinks, each sink once, whatever breaks in between.

The outputs of a batch are computed once and staged in a shared folder; the sinks read them
from there in turn, and each that is done is entered in a ledger. After a failure Spark
repeats the batch: outputs that are staged are not computed again, so all sinks get the
same rows even where these hold clock times or random numbers, and sinks that are done are
passed over. A sink that broke off gets its rows again and must replace or complete what is
there, as `parquet_target` and `jdbc_target` do.

Batches of a query run one after the other, so the ledger holds the last two of every sink
and the staging folder the outputs of two batches, however long the stream runs. The new
entry never overwrites the latest one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailprism.operators.verdicts import decide, to_verdict_row
from mailprism.sources.bus import as_messages
from mailprism.sources.verdict_table import Target
from mailprism.streaming.flow import aggregate_messages

Outputs = Callable[[DataFrame], Mapping[str, DataFrame]]

_STAGED = "staged"
_ENTRY = "batch_id bigint"


class SinkLedger:
    """Which batch each sink has finished, in a shared folder that belongs to one stream."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def _path(self, sink: str) -> str:
        return f"{self._folder}/ledger/{sink}"

    def last(self, sink: str) -> int:
        """The latest batch the sink has finished, -1 for none."""
        try:
            found = self._spark.read.schema(_ENTRY).json(f"{self._path(sink)}/*").agg({"batch_id": "max"}).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return -1 if found is None else found

    def enter(self, sink: str, batch_id: int) -> None:
        entry = self._spark.range(batch_id, batch_id + 1, 1, 1).withColumnRenamed("id", "batch_id")
        entry.write.mode("overwrite").json(f"{self._path(sink)}/{batch_id % 2}")

    def staged(self, batch_id: int, name: str) -> str:
        return f"{self._folder}/staged/{batch_id % 2}/{name}"

    def write(self, batch: DataFrame, batch_id: int, outputs: Outputs, targets: Mapping[str, Target]) -> None:
        """Bring the outputs of a batch to those of the targets that do not have them yet.

        Every target needs an output of its name; outputs without a target are not computed.
        """
        if _STAGED in targets:
            raise ValueError(f"{_STAGED!r} is the ledger's own entry and no name of a sink")
        open_sinks = [name for name in targets if self.last(name) < batch_id]
        if not open_sinks:
            return
        if self.last(_STAGED) < batch_id:
            frames = outputs(batch)
            lacking = sorted(set(targets) - set(frames))
            if lacking:
                raise ValueError(f"no output for {', '.join(lacking)}")
            for name in targets:
                frames[name].write.mode("overwrite").parquet(self.staged(batch_id, name))
            self.enter(_STAGED, batch_id)
        for name in open_sinks:
            targets[name](self._spark.read.parquet(self.staged(batch_id, name)), batch_id)
            self.enter(name, batch_id)


def topic_target(servers: str, topic: str, key: str | None = "task_id") -> Target:
    """Append to a topic. A batch that broke off while it was written is sent again as a whole."""

    def write(rows: DataFrame, batch_id: int) -> None:
        as_messages(rows, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def decided(messages: DataFrame) -> dict[str, DataFrame]:
    """What a batch of aggregate messages becomes: `aggregates`, `verdicts` and `dead_letters`."""
    aggregates, dead = aggregate_messages(messages)
    return {"aggregates": aggregates, "verdicts": to_verdict_row(decide(aggregates)), "dead_letters": dead}


def write_sinks(
    stream: DataFrame, outputs: Outputs, targets: Mapping[str, Target], checkpoint: str, every: str = "5 seconds", **trigger
) -> StreamingQuery:
    """Stream each output of `stream` into the target of its name.

    Ledger and staged rows lie in the checkpoint, so a stream that starts anew has a new ledger.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        # Only the rows of outputs that are not staged yet are read from the source.
        SinkLedger(batch.sparkSession, f"{checkpoint}/sinks").write(batch, batch_id, outputs, targets)

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": every}))
        .start()
    )
