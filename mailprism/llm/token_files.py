"""Token ids in Simple-8b files: written in document order, read back with vector decoding.

A shard is one Parquet file of segments, in the order of the documents. A segment holds
whole documents: their ids (`doc_ids`), numbers of tokens (`n_tokens`), the packed words
(`words`, little-endian 64-bit) and the offset of the first word of each block of 128 ids
(`block_words`). Spark's writer commits the files, so a lost executor leaves no half file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailprism.llm import simple8b
from mailprism.llm.common import new_path
from mailprism.llm.tokens import END_ID, TOKENIZER, crc_of, document_ids

SEGMENT_TOKENS = 1 << 17
# Characters of a text that may part rows of one id into ranges; the sort looks at all.
HEAD = 256
SEGMENT = (
    "shard int, segment int, doc_ids array<bigint>, n_tokens array<bigint>, total bigint, words binary, block_words array<bigint>"
)


def _segments(tokenizer: str, end_id: int, segment_tokens: int):
    def row(shard: int, number: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        words, offsets = simple8b.encode(tokens)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int64())), pa.array([len(tokens)], pa.int64()),
                pa.array([words.tobytes()], pa.binary()), pa.array([offsets], pa.list_(pa.int64())),
            ],
            ["shard", "segment", "doc_ids", "n_tokens", "total", "words", "block_words"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        ids, parts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                part = document_ids(text.as_py(), tokenizer, end_id)
                if held and held + len(part) > segment_tokens:
                    yield row(shard, number, ids, parts)
                    ids, parts, held, number = [], [], 0, number + 1
                ids.append(doc_id)
                parts.append(part)
                held += len(part)
        if parts:
            yield row(shard, number, ids, parts)

    return encode


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode whole texts in ascending order of the id and write the files.

    Rows without an id come first; rows that share one follow in the order of their texts,
    and ranges may end between them where their first `HEAD` characters differ. A NULL or
    empty text is the end id alone. An empty table gives no segment.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.left("text", F.lit(HEAD))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), SEGMENT).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words = np.frombuffer(row["words"], "<u8")
            ids = simple8b.decode(words, np.array(row["block_words"], np.int64), row["total"]).astype(np.uint32)
            counts = np.array(row["n_tokens"], np.int64)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * len(counts), pa.int32()), pa.array([row["segment"]] * len(counts), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                    pa.array([crc_of(ids[end - count : end]) for end, count in zip(ends, counts)], pa.int64()),
                ],
                ["shard", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files, decoded: its place in the order, length, CRC-32.

    The starts come from the numbers in the segments, not from the words: sums per shard
    are added up, then those in a shard.
    """
    files = spark.read.schema(SEGMENT).parquet(path)
    sizes = files.select("shard", "segment", "total")
    shards = sizes.groupBy("shard").agg(F.sum("total").alias("tokens"))
    # One row per shard, which is what the number of tasks bounds.
    first = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("of"), F.coalesce(F.sum("tokens").over(first), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("above"))
    starts = starts.join(shards, F.col("shard") == F.col("of")).select(
        F.col("shard").alias("s"), F.col("segment").alias("g"), (F.col("before") + F.col("above")).alias("base")
    )
    rows = files.mapInArrow(
        _read, "shard int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    joined = rows.join(starts, (F.col("shard") == F.col("s")) & (F.col("segment") == F.col("g")))
    return joined.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the token files of `docs` and read them back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_token_files(docs, path)
    return read_token_files(spark, path)
