"""Benchmark decontamination with a positional inverted index that is stored in segments.

The index of the training texts is a table of one row per segment: the dictionary of its
words, and for every word the places where it stands, in ascending order. Documents lie
behind one another in the places of their segment, with a gap, so no match crosses them. A
frequent word's list is thus spread over all segments, and no task holds more than one.

Test texts are cut into windows of some consecutive words. In each segment a window's lists
are taken from the rarest word on: the places of that word, less its offset in the window,
are the candidates, and each further list, shifted likewise, keeps those that it also holds.
What is left are exact phrases. For proximity the same lists are met within a distance, and
a window is near where some stretch of text holds all its words, each as often as the window.

Windows go to the tasks in blocks of bounded size; each block is one pass over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import new_path, written
from mailprism.llm.words import packed, segments, unpacked, words_of

WINDOW = 10
# Words that may stand between those of a window, for proximity.
SLACK = 5
# Places without words behind each document; more than any stretch looked at.
GAP = 64
# Pairs of window and item in a block, on average at most.
BLOCK_WINDOWS = 100_000
# Candidates that are looked up together in a task.
CHUNK = 1 << 20

INDEX = "segment bigint, terms array<binary>, counts array<int>, places binary, ids array<bigint>, starts array<int>, sizes array<int>"
HITS = "segment bigint, ordinal int, spans array<struct<first:int,last:int>>, items array<string>, near_items array<string>"


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for number, s in enumerate(segments(batches)):
        sizes = np.diff(s.bounds)
        starts = s.bounds[:-1] + GAP * np.arange(len(sizes))
        places = np.arange(len(s.codes)) + GAP * np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(s.codes, kind="stable")
        yield pa.RecordBatch.from_pydict({
            "segment": pa.array([task << 32 | number], pa.int64()),
            "terms": pa.array([s.terms], pa.list_(pa.binary())),
            "counts": pa.array([np.bincount(s.codes, minlength=len(s.terms)).astype(np.int32)], pa.list_(pa.int32())),
            "places": pa.array([packed(places[order])], pa.binary()),
            "ids": pa.array([s.ids], pa.list_(pa.int64())),
            "starts": pa.array([starts.astype(np.int32)], pa.list_(pa.int32())),
            "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
        })


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of whole texts, written in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_segment_rows, INDEX), "phrase-index")


def _window_rows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = {tuple(words[i : i + window]) for i in range(max(len(words) - window + 1, min(1, len(words))))}
                found = sorted(found)
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_pydict(
                        {"item": pa.array([item] * len(part), pa.string()), "words": pa.array(part, pa.list_(pa.string()))}
                    )

    return cut


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): the different windows of each item; of a shorter text that is not empty, the whole.

    An item without an id goes by the empty one; rows of one id are one item.
    """
    item = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = items.select(item.alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_window_rows(window), "item string, words array<string>").distinct()


class Block:
    """A bounded number of windows as rows of numbers into a sorted list of words."""

    def __init__(self, rows: list) -> None:
        texts = sorted({tuple(r.words) for r in rows})
        number = {t: i for i, t in enumerate(texts)}
        pairs = sorted({(number[tuple(r.words)], r.item) for r in rows})
        self.items = sorted({item for _, item in pairs})
        place = {item: i for i, item in enumerate(self.items)}
        self.item_of = np.array([place[item] for _, item in pairs], np.int64)
        self.first_item = np.searchsorted([w for w, _ in pairs], np.arange(len(texts) + 1))
        vocabulary = sorted({w for t in texts for w in t})
        code = {w: i for i, w in enumerate(vocabulary)}
        self.vocabulary = pa.array([w.encode() for w in vocabulary], pa.binary())
        self.sizes = np.array([len(t) for t in texts], np.int64)
        width = int(self.sizes.max(initial=1))
        self.words = np.full((len(texts), width), -1, np.int64)
        # Different words of a window and how often it has them.
        self.different, self.needed = self.words.copy(), np.zeros_like(self.words)
        for i, t in enumerate(texts):
            self.words[i, : len(t)] = [code[w] for w in t]
            kinds, often = np.unique(self.words[i, : len(t)], return_counts=True)
            self.different[i, : len(kinds)], self.needed[i, : len(kinds)] = kinds, often

    def items_of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `found`, item) for every item of every window in `found`."""
        each = self.first_item[found + 1] - self.first_item[found]
        at = np.repeat(np.arange(len(found)), each)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
        return at, self.item_of[self.first_item[found][at] + inner]


class Lists:
    """The lists of one segment: places of all words behind one another, by word and place."""

    def __init__(self, row: dict) -> None:
        self.starts, self.sizes = np.array(row["starts"], np.int64), np.array(row["sizes"], np.int64)
        self.counts = np.array(row["counts"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.places = unpacked(row["places"])
        self.terms = pa.array(row["terms"], pa.binary())
        # Wide enough that no place less an offset or more a stretch reaches another word.
        self.room = int(self.starts[-1] + self.sizes[-1] if len(self.starts) else 0) + 4 * GAP
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.room + self.places + GAP

    def codes(self, block: Block, words: np.ndarray) -> np.ndarray:
        """The words' numbers in this segment; -1 beyond a window's end, -2 for one that is absent."""
        here = pc.index_in(block.vocabulary, value_set=self.terms).fill_null(-2).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(words < 0, -1, here[words])

    def at(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Number of the first entry of the word's list at or behind the place."""
        return np.searchsorted(self.keys, code * self.room + place + GAP)

    def next(self, code: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Steps from the place to the word's first place at or behind it; very many if there is none."""
        key = code * self.room + place + GAP
        at = np.searchsorted(self.keys, key)
        return np.where(at < len(self.keys), self.keys[np.minimum(at, len(self.keys) - 1)] - key, self.room)

    def documents(self, place: np.ndarray) -> np.ndarray:
        """The document of a place; the last one of those that begin there, which is the one with words."""
        return np.searchsorted(self.starts, place, side="right") - 1


def _rarest_first(lists: Lists, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows all of whose words occur, their columns in ascending length of the lists)."""
    alive = np.flatnonzero((codes != -2).all(axis=1))
    lengths = np.where(codes[alive] < 0, np.iinfo(np.int64).max, lists.counts[codes[alive]])
    return alive, np.argsort(lengths, axis=1, kind="stable")


def _candidates(lists: Lists, windows_: np.ndarray, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row in `windows_`, place of its rarest word), a bounded number at a time."""
    often = lists.counts[rarest]
    ends = np.cumsum(often)
    begin = 0
    while begin < len(windows_):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, side="right")))
        each = often[begin:end]
        row = np.repeat(np.arange(begin, end), each)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        yield row, lists.places[lists.first[rarest[row]] + inner]
        begin = end


def phrases(lists: Lists, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every exact occurrence."""
    codes = lists.codes(block, block.words)
    alive, order = _rarest_first(lists, codes)
    codes = codes[alive]
    rarest = np.take_along_axis(codes, order[:, :1], axis=1)[:, 0]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for row, place in _candidates(lists, alive, rarest):
        start = place - order[row, 0]
        for step in range(1, codes.shape[1]):
            offset = order[row, step]
            code = codes[row, offset]
            keep = code < 0
            some = np.flatnonzero(~keep)
            keep[some] = lists.next(code[some], start[some] + offset[some]) == 0
            row, start = row[keep], start[keep]
        found.append((alive[row], start))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def near(lists: Lists, block: Block, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, document), distinct: all the window's words within its length and `slack` more words, in any order."""
    codes = lists.codes(block, block.different)
    alive, order = _rarest_first(lists, codes)
    codes, needed = codes[alive], block.needed[alive]
    reach = block.sizes[alive] + slack
    rarest = np.take_along_axis(codes, order[:, :1], axis=1)[:, 0]
    pairs = [np.zeros(0, np.int64)]
    for row, place in _candidates(lists, alive, rarest):
        for step in range(1, codes.shape[1]):
            code = codes[row, order[row, step]]
            keep = code < 0
            some = np.flatnonzero(~keep)
            before = place[some] - reach[row[some]] + 1
            keep[some] = lists.next(code[some], before) <= 2 * (reach[row[some]] - 1)
            row, place = row[keep], place[keep]
        # Every stretch that holds the rarest word's place; GAP keeps it inside one document.
        for part in (slice(i, i + (CHUNK >> 5)) for i in range(0, len(row), CHUNK >> 5)):
            back = np.arange(int(reach.max(initial=1)))
            stretch, shift = np.nonzero(back < reach[row[part]][:, None])
            r, begin = row[part][stretch], place[part][stretch] - shift
            whole = np.ones(len(r), bool)
            for column in range(codes.shape[1]):
                at = np.flatnonzero(whole & (codes[r, column] >= 0))
                code = codes[r[at], column]
                whole[at] = lists.at(code, begin[at] + reach[r[at]]) - lists.at(code, begin[at]) >= needed[r[at], column]
            document = lists.documents(place[part][stretch][whole])
            pairs.append(np.unique(alive[r[whole]] * (len(lists.starts) + 1) + document))
    key = np.unique(np.concatenate(pairs))
    return key // (len(lists.starts) + 1), key % (len(lists.starts) + 1)


def _named(block: Block, n: int, window: np.ndarray, document: np.ndarray) -> dict[int, list[str]]:
    """Different items by document, for pairs of window and document."""
    key = np.unique(window * n + document)
    at, item = block.items_of(key // n)
    key = np.unique((key % n)[at] * len(block.items) + item)
    out: dict[int, list[str]] = {}
    for d, i in zip((key // len(block.items)).tolist(), (key % len(block.items)).tolist()):
        out.setdefault(d, []).append(block.items[i])
    return out


def _hits(shared, slack: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row)
                if not len(lists.places):
                    continue
                n = len(lists.starts)
                window, start = phrases(lists, block)
                exact = _named(block, n, window, lists.documents(start))
                close = _named(block, n, *near(lists, block, slack))
                # Runs of covered places.
                depth = np.zeros(lists.room + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + block.sizes[window], -1)
                covered = np.concatenate([[False], np.cumsum(depth) > 0, [False]])
                edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
                spans: dict[int, list[dict]] = {}
                for d, (first, last) in zip(lists.documents(edges[:, 0]).tolist(), edges.tolist()):
                    base = int(lists.starts[d])
                    spans.setdefault(d, []).append({"first": first - base, "last": last - base})
                found = sorted({*exact, *close})
                span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([row["segment"]] * len(found), pa.int64()),
                    "ordinal": pa.array(found, pa.int32()),
                    "spans": pa.array([spans.get(d, []) for d in found], span),
                    "items": pa.array([exact.get(d, []) for d in found], pa.list_(pa.string())),
                    "near_items": pa.array([close.get(d, []) for d in found], pa.list_(pa.string())),
                })

    return find


def search_index(index: DataFrame, cut: DataFrame, slack: int = SLACK, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Hits of the windows `cut` by document: spans of covered words (from, to), exact and near items.

    A document has one row for each block that hits it; the spans of a row do not meet. Near
    items include the exact ones. Spans count words of the document from 0.
    """
    if not 0 <= slack <= GAP - WINDOW:
        raise ValueError("the gap between documents does not cover the stretch")
    spark = index.sparkSession
    cut = written(cut, "windows")
    blocks = max(1, -(-cut.count() // block_windows))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    path = new_path(spark, "phrase-hits")
    for number in range(blocks):
        rows = cut.filter(F.col("block") == number).select("item", "words").collect()
        shared = spark.sparkContext.broadcast(Block(rows))
        hits = index.select("segment", "terms", "counts", "places", "starts", "sizes").mapInArrow(_hits(shared, slack), HITS)
        hits.write.parquet(f"{path}/block={number}")
        shared.destroy()
    return spark.read.schema(HITS).parquet(path)


def _covered(spans: Column) -> Column:
    """Words in at least one of the spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    whole = F.aggregate(
        F.array_sort(spans), start,
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], done["reach"]))).alias("n"),
            F.greatest(done["reach"], s["last"]).alias("reach"),
        ),
    )
    return whole["n"].cast("long")


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, block_windows: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: its words, those inside an occurrence of a window, and its items.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and
    near_items (both sorted), spans (of covered words, by start; those of different blocks
    may meet). A NULL text is an empty one, with no words and no hit; an item without words
    has no window. Repeated rows are documents each; rows without an id keep none. With an
    empty table of items nothing is hit; an empty table of documents gives no rows. Columns
    beside id and text are not read.
    """
    index = build_index(docs, id_col, text_col)
    hits = search_index(index, windows(items, window, item_col, item_text_col), slack, block_windows)
    each = index.select("segment", F.posexplode(F.arrays_zip("ids", "sizes")).alias("ordinal", "d"))
    each = each.select("segment", "ordinal", F.col("d.ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words"))
    merged = hits.groupBy("segment", "ordinal").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    none = F.array().cast("array<string>")
    found = each.join(merged, ["segment", "ordinal"], "left").select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "items", "near_items", "spans",
    )
