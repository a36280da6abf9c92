"""Ranked lexical search: posting lists with range-maximum tables, document intervals best first.

The index is a table of one row per segment of documents: its words, and for each word the
documents that hold it and how often. Counts over all segments give the words' weights.

A search works segment by segment. The documents of a segment are in the order of their ids.
Over the impacts of each posting list lies a sparse table, which tells the largest impact in
any range of documents in constant time; the sum of these maxima over the item's words bounds
every score in the range. The search starts with the range of all documents. It takes the
ranges of the highest bounds, splits each at the document where the word that adds most has
its maximum, scores that document, and puts back the parts whose bound may still reach the
item's best k. These go on from segment to segment of a task, so later segments are mostly
cut off at once. Only k rows per item leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailprism.llm.common import new_path, written
from mailprism.llm.words import packed, segments, unpacked, words_of

K = 20
SCALE = 1_000_000_000
# Pairs of item and word in a block, on average at most.
BLOCK_PAIRS = 100_000
# Ranges split at once; a share of those that wait, this many at least.
SPLIT, SHARE = 16, 8
# Tasks whose best rows are ranked together first.
BUCKETS = 64

INDEX = (
    "segment bigint, n_docs bigint, n_terms bigint, terms array<binary>, dfs array<int>, docs binary, tfs binary, "
    "ids array<bigint>, lengths array<int>"
)
FOUND = "item int, doc_id bigint, score bigint, bucket int"
_LAST = np.iinfo(np.int64).max


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, s in enumerate(segments(batches)):
        lengths = np.diff(s.bounds)
        order = pc.sort_indices(s.ids, null_placement="at_end").to_numpy().astype(np.int64)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        n = max(1, len(order))
        key, often = np.unique(s.codes * n + np.repeat(place, lengths), return_counts=True)
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([task << 32 | number], pa.int64()),
            "n_docs": pa.array([int((lengths > 0).sum())], pa.int64()),
            "n_terms": pa.array([len(s.codes)], pa.int64()),
            "terms": pa.array([s.terms], pa.list_(pa.binary())),
            "dfs": pa.array([np.bincount(key // n, minlength=len(s.terms)).astype(np.int32)], pa.list_(pa.int32())),
            "docs": pa.array([packed(key % n)], pa.binary()),
            "tfs": pa.array([packed(often)], pa.binary()),
            "ids": pa.array([s.ids.take(pa.array(order))], pa.list_(pa.int64())),
            "lengths": pa.array([lengths[order].astype(np.int32)], pa.list_(pa.int32())),
        })


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts, written in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_segment_rows, INDEX), "postings")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            terms, often = np.unique(np.array(words_of(text), dtype=object), return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([key] * len(terms), pa.int64()),
                "term": pa.array([t.encode() for t in terms], pa.binary()), "often": pa.array(often, pa.int64()),
            })


class Block:
    """A bounded number of items: for each its words, as numbers into a list, times weight and repeats."""

    def __init__(self, rows: list, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        vocabulary = sorted({r.term for r in rows})
        number = {t: i for i, t in enumerate(vocabulary)}
        self.vocabulary = pa.array(vocabulary, pa.binary())
        self.keys = sorted({r.key for r in rows})
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        mine: dict[int, list] = {}
        for r in rows:
            weight = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * r.df + 1))))
            if weight > 0:
                mine.setdefault(r.key, []).append((number[r.term], weight * r.often))
        for key in self.keys:
            pairs = np.array(sorted(mine.get(key, [])), np.int64).reshape(-1, 2)
            self.items.append((pairs[:, 0], pairs[:, 1]))


class Postings:
    """The lists of one segment for a block's words, with a sparse table of their maxima."""

    def __init__(self, row: dict, block: Block) -> None:
        self.n = len(row["lengths"])
        ids = pa.array(row["ids"], pa.int64())
        self.known = ~ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        dfs = np.array(row["dfs"], np.int64)
        ends = np.cumsum(dfs)
        here = pc.index_in(block.vocabulary, value_set=pa.array(row["terms"], pa.binary()))
        here = here.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.where(here < 0, 0, dfs[here]) if len(dfs) else np.zeros(len(here), np.int64)
        # Of the block's word i: entries first[i] to last[i].
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        take = np.repeat(ends[here] - sizes - self.first, sizes) + np.arange(int(sizes.sum())) if len(dfs) else np.zeros(0, np.int64)
        self.docs = unpacked(row["docs"])[take]
        tf = unpacked(row["tfs"])[take]
        length = np.array(row["lengths"], np.int64)
        m = 100 - 25 + (25 * length * block.n_docs) // max(1, block.n_terms)
        self.impact = (SCALE * tf) // (1000 * tf + 12 * m[self.docs])
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * (self.n + 1) + self.docs
        # tables[j][i]: where the largest of the impacts i to i + 2^j - 1 is, the first of equal ones.
        self.tables = [np.arange(len(self.docs), dtype=np.int32)]
        for j in range(1, int(sizes.max(initial=1)).bit_length()):
            below = self.tables[-1]
            left, right = below[: -(1 << (j - 1))], below[1 << (j - 1) :]
            best = np.full(len(below), 0, np.int32)
            best[: len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.tables.append(best)
        self.tables = np.stack(self.tables)
        self.levels = np.zeros(int(sizes.max(initial=0)) + 1, np.int64)
        for i in range(2, len(self.levels)):
            self.levels[i] = self.levels[i >> 1] + 1

    def maxima(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(impact, entry) of the largest impact among the entries first to last - 1; 0 for none."""
        size = last - first
        level = self.levels[size]
        some = size > 0
        left = self.tables[level, np.where(some, first, 0)]
        right = self.tables[level, np.where(some, last - (1 << level), 0)]
        best = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(some, self.impact[best], 0), best


@dataclass
class Best:
    """The k best documents of an item so far, best first."""

    scores: np.ndarray
    ids: np.ndarray
    known: np.ndarray

    def add(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> None:
        scores, ids, known = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        order = np.lexsort((~known, ids, -scores))[:k]
        order = order[scores[order] > 0]
        self.scores, self.ids, self.known = scores[order], ids[order], known[order]


def search_segment(lists: Postings, words: np.ndarray, weights: np.ndarray, best: Best, k: int) -> int:
    """Add the segment's documents that belong to the item's k best; returns how many were scored."""
    here = lists.last[words] > lists.first[words]
    words, weights = words[here], weights[here]
    if not len(words):
        return 0
    base = words * (lists.n + 1)
    # Waiting ranges of documents low to high - 1, and where the words' lists enter and leave them.
    low, high = np.array([0]), np.array([lists.n])
    first, last = lists.first[words][None, :], lists.last[words][None, :]
    scored = 0
    while True:
        impact, entry = lists.maxima(first, last)
        parts = impact * weights
        bound = parts.sum(axis=1)
        top = parts.argmax(axis=1)
        split = lists.docs[np.take_along_axis(entry, top[:, None], axis=1)[:, 0]]
        if low is not None and scored == 0:
            waiting = [bound, low, high, first, last, split]
        else:
            waiting = [np.concatenate(x) for x in zip(waiting, [bound, low, high, first, last, split])]
        # A range of equal bound matters only where it has a smaller id.
        full = len(best.scores) == k
        least, least_id = (best.scores[-1], best.ids[-1]) if full else (0, _LAST)
        open_ = waiting[0] > least
        if full:
            open_ |= (waiting[0] == least) & (lists.ids[np.minimum(waiting[1], lists.n - 1)] < least_id)
        waiting = [x[open_] for x in waiting]
        if not len(waiting[0]):
            return scored
        some = min(len(waiting[0]), max(SPLIT, len(waiting[0]) // SHARE))
        chosen = np.zeros(len(waiting[0]), bool)
        chosen[np.argpartition(-waiting[0], some - 1)[:some]] = True
        _, low, high, first, last, doc = (x[chosen] for x in waiting)
        waiting = [x[~chosen] for x in waiting]
        at = np.searchsorted(lists.keys, base + doc[:, None])
        there = (at < last) & (lists.docs[np.minimum(at, len(lists.docs) - 1)] == doc[:, None])
        scores = (np.where(there, lists.impact[np.minimum(at, len(lists.docs) - 1)], 0) * weights).sum(axis=1)
        best.add(scores, lists.ids[doc], lists.known[doc], k)
        scored += len(doc)
        low, high = np.concatenate([low, doc + 1]), np.concatenate([doc, high])
        first, last = np.concatenate([first, at + there]), np.concatenate([at, last])
        left = low < high
        low, high, first, last = low[left], high[left], first[left], last[left]


def _search(shared, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        none = np.zeros(0, np.int64)
        best = [Best(none, none, np.zeros(0, bool)) for _ in block.items]
        for batch in batches:
            for row in batch.to_pylist():
                lists = Postings(row, block)
                if not len(lists.docs):
                    continue
                for (words, weights), mine in zip(block.items, best):
                    search_segment(lists, words, weights, mine, k)
        size = [len(b.scores) for b in best]
        joined = lambda name: np.concatenate([none, *(getattr(b, name) for b in best)])
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(np.repeat(np.arange(len(best)), size), pa.int32()),
            "doc_id": pa.array(joined("ids"), pa.int64(), mask=~joined("known").astype(bool)),
            "score": pa.array(joined("scores"), pa.int64()),
            "bucket": pa.array(np.full(sum(size), TaskContext.get().partitionId() % BUCKETS), pa.int32()),
        })

    return find


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every row of `items`.

    Equal scores go by ascending id, unknown ids last. A NULL text has no words and no
    document. Each row of `items` is an item, so rows that repeat give repeated results; an
    item without words has none. Repeated rows of `docs` are documents each. An empty table
    gives no rows. Columns beside id and text are not read. Scores wrap beyond 64 bits.
    """
    spark = docs.sparkSession
    index = build_postings(docs, id_col, text_col)
    rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "items")
    pairs = rows.select("key", "text").mapInArrow(_item_terms, "key bigint, term binary, often bigint")
    # How many documents hold each word that an item asks for: counts are added before the shuffle.
    dfs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("n"))
    dfs = dfs.join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    pairs = written(pairs.join(dfs, "term"), "item-terms")
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    # Whole items by hash, so a block has the size of its longest item at least.
    blocks = max(1, -(-pairs.count() // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    path = new_path(spark, "found")
    for number in range(blocks):
        block = Block(pairs.filter(F.col("block") == number).select("key", "term", "often", "df").collect(), *totals)
        shared = spark.sparkContext.broadcast(block)
        names = spark.createDataFrame([(i, int(key)) for i, key in enumerate(block.keys)], "item int, key bigint")
        found = index.mapInArrow(_search(shared, k), FOUND).join(F.broadcast(names), "item").drop("item")
        found.write.parquet(f"{path}/block={number}")
        shared.destroy()
    found = spark.read.schema("doc_id bigint, score bigint, bucket int, key bigint").parquet(path)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["key", "bucket"], ["key"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(rows.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
