"""Exact top-k by inner product: histogram selection.

Every query is scored against every row, block of queries by block, and nothing but counts
leaves a task: a histogram of the scores of each query over the range where its k-th score
must lie. The sum over all tasks tells the bin of the k-th score, which is the next range;
after a few rounds it is one value, or so few rows lie above its lower end that they can be
returned. Rows that tie with the k-th score are settled the same way by their ids. One last
pass returns the rows above the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailprism.llm.common import written

K = 10
SCALE = 1024
EVERY = 100
# Queries whose vectors and ranges are sent to the tasks at once.
BLOCK_QUERIES = 1024
BINS = 64
# A query is settled when at most so many times k rows are above its cut.
SLACK = 8
# Rows scored at a time in a task.
CHUNK_ROWS = 2048
_MOST = np.iinfo(np.int64).max
RANGES = "q int, low bigint, high bigint"
HISTOGRAM = "q int, bin int, n bigint"
HITS = "q int, vec_id bigint, score bigint"


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as long; NULL if the vector cannot take part."""
    values = F.transform(vector, lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    whole = F.transform(values, lambda x: F.floor(x * scale).cast("long"))
    return F.when(vector.isNotNull() & ~F.exists(values, bad), whole)


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products: in floating point where that is exact, else in integers."""
    size = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if size < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


class Block:
    """A bounded block of queries: ids, vectors by dimension, and where each k-th score lies."""

    def __init__(self, ids: list[int], vectors: list[list[int]]) -> None:
        self.ids = np.array(ids, np.int64)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for v in vectors])
        for dim in set(sizes.tolist()):
            at = np.flatnonzero(sizes == dim)
            self.by_dim[dim] = at, np.array([vectors[i] for i in at], np.int64).reshape(len(at), dim)
        n = len(ids)
        # The k-th score lies in [low, high]; once low == high the k-th id does in [first, last].
        self.low, self.high, self.first, self.last = (np.zeros(n, np.int64) for _ in range(4))
        # Rows at or above the lower end; true where there are fewer than k in all.
        self.reached, self.few = np.full(n, _MOST), np.zeros(n, bool)

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(queries, scores, ids of the rows, true where a row is not the query itself)."""
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim, (at, vectors) in self.by_dim.items():
                mine = np.flatnonzero(sizes == dim)
                for part in (mine[i : i + CHUNK_ROWS] for i in range(0, len(mine), CHUNK_ROWS)):
                    rows = values[starts[part][:, None] + np.arange(dim)]
                    yield at, _scores(rows, vectors), ids[part], self.ids[at][:, None] != ids[part]


def _span(low: np.ndarray, value: np.ndarray) -> np.ndarray:
    """value - low for value >= low, also where the difference needs all 64 bits."""
    return (value - low).view(np.uint64)


def _width(low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Width of the bins of each range; the last bin may be narrower."""
    return _span(low, high) // np.uint64(bins) + np.uint64(1)


def _ranges(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        low, high = np.full(len(block.ids), _MOST), np.full(len(block.ids), -_MOST)
        for at, scores, _, other in block.scored(batches):
            low[at] = np.minimum(low[at], np.where(other, scores, _MOST).min(axis=1))
            high[at] = np.maximum(high[at], np.where(other, scores, -_MOST).max(axis=1))
        q = np.flatnonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(low[q]), pa.array(high[q])], ["q", "low", "high"])

    return find


def _histogram(shared, by_id: bool, bins: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros((len(block.ids), bins + 1), np.int64)  # the last bin: rows better than the range
        for at, scores, ids, other in block.scored(batches):
            low, high = block.low[at][:, None], block.high[at][:, None]
            if by_id:
                # Better are higher scores, and ties with smaller ids.
                value, start, end = np.broadcast_to(ids, scores.shape), block.first[at][:, None], block.last[at][:, None]
                tie = (low == high) & (scores == low)
                inside, better = tie & (value >= start) & (value <= end), (scores > high) | (tie & (value < start))
            else:
                value, start, end = scores, low, high
                inside, better = (scores >= low) & (scores <= high), scores > high
            inside &= other
            q, row = np.nonzero(inside)
            width = _width(start, end, bins)[:, 0]
            slot = (_span(start[q, 0], value[q, row]) // width[q]).astype(np.int64)
            size = len(at) * bins
            total[at, :bins] += np.bincount(q * bins + slot, minlength=size)[:size].reshape(len(at), bins)
            total[at, bins] += (better & other).sum(axis=1)
        q, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[q, slot])], ["q", "bin", "n"]
        )

    return count


def _hits(shared, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for at, scores, ids, other in block.scored(batches):
            low, high, last = block.low[at][:, None], block.high[at][:, None], block.last[at][:, None]
            q, row = np.nonzero(other & ((scores > low) | ((scores == low) & ((low < high) | (ids <= last)))))
            # Of many equal rows no task needs to return more than k.
            order = np.lexsort((ids[row], -scores[q, row], q))
            q, row = q[order], row[order]
            few = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, row = q[few], row[few]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[q], pa.int32()), pa.array(ids[row]), pa.array(scores[q, row])], ["q", "vec_id", "score"]
            )

    return find


def _narrow(rows: DataFrame, block: Block, by_id: bool, k: int, bins: int) -> None:
    """One histogram over all rows; each query's range becomes the bin of its k-th row."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    counts = rows.mapInArrow(_histogram(shared, by_id, bins), HISTOGRAM).groupBy("q", "bin").agg(F.sum("n").alias("n"))
    n = len(block.ids)
    total = np.zeros((n, bins + 1), np.int64)
    for q, slot, count in counts.collect():  # bins + 1 rows per query of the block at most
        total[q, slot] = count
    shared.destroy()
    start, end = (block.first, block.last) if by_id else (block.low, block.high)
    # From the best bin on: rows in it or in a better one.
    inside = total[:, :bins] if by_id else total[:, :bins][:, ::-1]
    reached = total[:, bins:] + inside.cumsum(axis=1)
    enough = reached >= k
    place = np.argmax(enough, axis=1)
    some = enough.any(axis=1)
    if by_id:
        some &= block.low == block.high
    else:
        block.few = ~some
    block.reached = np.where(some, reached[np.arange(n), place], block.reached)
    slot = (place if by_id else bins - 1 - place).astype(np.uint64)
    width = _width(start, end, bins)
    first = start + (slot * width).view(np.int64)
    last = np.minimum(end, first + (width - np.uint64(1)).view(np.int64))
    start[some], end[some] = first[some], last[some]


def _cut(rows: DataFrame, block: Block, k: int, bins: int, ids: tuple[int, int]) -> None:
    """Find for every query of the block a cut with k rows above it, or a few more."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    ranges = rows.mapInArrow(_ranges(shared), RANGES).groupBy("q").agg(F.min("low"), F.max("high")).collect()
    shared.destroy()
    for q, low, high in ranges:
        block.low[q], block.high[q] = low, high
    block.first[:], block.last[:] = ids
    for by_id in (False, True):
        start, end = (block.first, block.last) if by_id else (block.low, block.high)
        while (~block.few & (block.reached > SLACK * k) & (start < end)).any():
            _narrow(rows, block, by_id, k, bins)


def top_k(
    spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, bins: int = BINS,
    block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id `every` divides.

    A vector that is NULL or holds a NULL or a component that is not finite takes no part,
    nor does a row without an id. Vectors are compared with those of the same length only;
    components outside 64 bits stop at its ends and inner products wrap there. Rows that
    repeat are candidates each, but one query; no row with the query's id is its hit. An
    empty table gives no row.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector"))
    rows = written(rows.filter("vec_id is not null and vector is not null"), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).distinct()
    # Blocks of bounded size: queries are numbered within (hash) blocks of half that size on average.
    count = queries.count()
    ends = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    blocks = max(1, -(-2 * count // block_queries))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block"), "queries")
    found = []
    for number in range(blocks if count else 0):
        taken = queries.filter(F.col("block") == number).orderBy("vec_id").collect()
        if not taken:
            continue
        block = Block([r.vec_id for r in taken], [r.vector for r in taken])
        _cut(rows, block, k, bins, (ends[0], ends[1]))
        shared = spark.sparkContext.broadcast(block)
        names = spark.createDataFrame([(i, int(v)) for i, v in enumerate(block.ids)], "i int, query_id bigint")
        hits = rows.mapInArrow(_hits(shared, k), HITS)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(names), F.col("q") == F.col("i")).select("query_id", "rank", "vec_id", "score")
        found.append(written(ranked, "hits"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
