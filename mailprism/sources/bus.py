"""Message bus: Kafka topics in and out.

The Kafka connector is not part of every Spark build, so the operators take any frame with
`value, topic, timestamp`; these two functions are the only place that names the connector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailprism import schemas


# Bits of topic and partition in a sequence number; 39 are left for the offset.
TOPIC_BITS, PARTITION_BITS = 6, 18


def sequence_number(topics: list[str], topic: str = "topic", partition: str = "partition", offset: str = "offset") -> Column:
    """A number that no other message of these topics has; in a partition it rises with the offset."""
    if not 0 < len(topics) <= 1 << TOPIC_BITS:
        raise ValueError(f"between 1 and {1 << TOPIC_BITS} topics can be told apart")
    place = F.array_position(F.array(*(F.lit(t) for t in topics)), F.col(topic)) - 1
    number = F.shiftleft(F.col(offset).cast("long"), TOPIC_BITS + PARTITION_BITS)
    number = number + F.shiftleft(F.col(partition).cast("long"), TOPIC_BITS) + place
    known = (F.col(partition) < 1 << PARTITION_BITS) & (F.col(offset) < 1 << (63 - TOPIC_BITS - PARTITION_BITS)) & (place >= 0)
    return F.when(known, number).otherwise(F.raise_error(F.lit("topic, partition or offset beyond the sequence number")).cast("long"))


def read_topic(
    spark: SparkSession,
    servers: str,
    *topics: str,
    starting_offsets: str = "latest",
    max_offsets_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming frame of one topic or several: value, topic, timestamp, seq.

    `starting_offsets` counts for the first start only; afterwards the checkpoint decides.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    return reader.load().select("value", "topic", "timestamp", sequence_number(list(topics)).alias("seq"))


def read_results(spark: SparkSession, servers: str, **kwargs) -> DataFrame:
    """The four analysis topics as one stream; `topic` tells them apart."""
    return read_topic(spark, servers, *schemas.ANALYSIS_TOPICS, **kwargs)


def as_messages(rows: DataFrame, key: Column | str | None = "task_id") -> DataFrame:
    """Rows as JSON messages; keyed by task, so one partition holds all of a task."""
    value = F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}).alias("value")
    if key is None:
        return rows.select(value)
    column = F.col(key) if isinstance(key, str) else key
    return rows.select(column.cast("string").alias("key"), value)


def write_topic(
    rows: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = "task_id", every: str = "5 seconds"
) -> StreamingQuery:
    """Stream rows to a topic."""
    return (
        as_messages(rows, key)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .start()
    )
