"""Documents packed into sequences: bounded-space best fit.

A document is cut only if it is longer than a sequence; its full pieces are sequences of
their own. The other pieces go through an online best fit with a fixed number of open bins.
Bins are kept by free space, a bitset says which free spaces occur, so the tightest bin
that fits is found with one shift. If too many bins are open the fullest closes.

A task feeds its pieces in random runs, each from long to short: the short pieces of a run
fill the bins that its long ones opened. What lies in bins still open at the end of a task
is packed again by fewer tasks, until one task is left, so the waste does not grow with the
number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import written
from mailprism.llm.tokens import END_ID, TOKENIZER, crc_of, document_ids

SEQUENCE_TOKENS = 2048
OPEN_BINS = 8192
# Pieces per task in a round, and per run in a task.
TASK_PIECES, RUN_PIECES = 100_000, 8192
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, open boolean"


def cuts(tokens: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first may be shorter."""
    head = tokens % limit
    starts = ([0] if head else []) + list(range(head, tokens, limit))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], tokens])]


def _pieces(tokenizer: str, end_id: int, limit: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = document_ids(text.as_py(), tokenizer, end_id)
                for number, (start, length) in enumerate(cuts(len(ids), limit)):
                    rows.append((doc_id, number, start, length, crc_of(ids[start : start + length])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return cut


class OpenBins:
    """At most `most` open bins of `size`, found by free space."""

    def __init__(self, size: int, most: int) -> None:
        self._size, self._most = size, most
        self._bins: list[list[int]] = [[] for _ in range(size + 1)]
        self._free = 0  # bit f is set if a bin with free space f is open
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of `length`."""
        fitting = self._free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self._most:
                self._take((self._free & -self._free).bit_length() - 1)
            space, number = self._size, self.made
            self.made += 1
        left = space - length
        if left:
            self._bins[left].append(number)
            self._free |= 1 << left
            self.open += 1
        return number, self._size - space

    def _take(self, space: int) -> int:
        number = self._bins[space].pop()
        if not self._bins[space]:
            self._free &= ~(1 << space)
        self.open -= 1
        return number

    def still_open(self) -> np.ndarray:
        return np.array([n for bins in self._bins for n in bins], np.int64)


def _pack(limit: int, most: int, round_number: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, held = OpenBins(limit, most), []
        for batch in batches:
            places = [bins.place(n) for n in batch.column("length").to_pylist()]
            number = np.array([p[0] for p in places], np.int64)
            held.append((batch, number, [p[1] for p in places]))
        open_bins = bins.still_open()
        base = (round_number << 56) + (TaskContext.get().partitionId() << 32)
        for batch, number, offset in held:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number + base), pa.array(offset, pa.int64()), pa.array(np.isin(number, open_bins))],
                [*batch.schema.names, "bin", "offset", "open"],
            )

    return pack


def cut_documents(
    docs: DataFrame, limit: int = SEQUENCE_TOKENS, tokenizer: str = TOKENIZER, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents; a NULL or empty text is the end id alone."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, end_id, limit), PIECE)


def pack_documents(
    docs: DataFrame, limit: int = SEQUENCE_TOKENS, most_open: int = OPEN_BINS, task_pieces: int = TASK_PIECES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Repeated rows are packed one by one; rows without an id are packed as well. An empty
    table gives no row. A task holds `task_pieces` small rows at most on average.
    """
    pieces = written(cut_documents(docs, limit, id_col=id_col, text_col=text_col), "pieces")
    whole = pieces.filter(F.col("length") == limit).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, done, number, tasks = pieces.filter(F.col("length") < limit), [whole], 1, None
    while True:
        count = rest.count()
        wanted = max(1, -(-count // task_pieces))
        tasks = wanted if tasks is None else min(wanted, max(1, tasks // 4))
        mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
        runs = max(1, -(-count // (tasks * RUN_PIECES)))
        run = F.pmod(F.shiftright(mixed, 20), F.lit(runs))
        dealt = rest.repartition(tasks, mixed).sortWithinPartitions(run, F.desc("length"), mixed, "doc_id", "piece")
        packed = written(dealt.mapInArrow(_pack(limit, most_open, number), PLACED), "packed")
        final = packed if tasks == 1 else packed.filter(~F.col("open"))
        done.append(final.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset"))
        if tasks == 1:
            break
        rest, number = packed.filter("open").select(*pieces.columns), number + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
