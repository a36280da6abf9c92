"""Batch replay of the keyed aggregation buffer.

A buffer opens with the first result of a task. It closes when four analyzer types are in
it, or with the first message that arrives after the deadline but before the next sweep.
At the sweep an unfinished buffer is thrown away, and a later message opens a new one. One
such life of a buffer is called an episode here. Where an episode starts depends on the
one before it, so a task is folded in arrival order.

Ordinary tasks are folded in one streaming pass over rows sorted inside each partition;
the fold holds one small state, never a group. Tasks with more than `split_rows` rows are
cut into blocks of time instead: for each block it is worked out where an episode would
leave the block for every row at which one could enter it, the few entry points that are
really used are looked up along the blocks, and all blocks are then labelled in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailprism import schemas
from mailprism.session import cut_lineage

# More hot tasks than this are matched by a shuffle join instead of a broadcast.
_BROADCAST_TASKS = 10_000


@dataclass(frozen=True)
class EpisodeRules:
    """Clocks of the buffer in milliseconds; `sweep_ms=0` expires at the deadline itself."""

    timeout_ms: int = schemas.TASK_TIMEOUT_MS
    sweep_ms: int = schemas.SWEEP_MS
    expected: int = schemas.EXPECTED_ANALYZERS

    def expiry(self, opened):
        """First sweep at or after the deadline; sweeps happen at multiples of the period."""
        deadline = opened + self.timeout_ms
        if self.sweep_ms == 0:
            return deadline
        return -(-deadline // self.sweep_ms) * self.sweep_ms

    @property
    def reach_ms(self) -> int:
        """No episode holds a message this long, or longer, after its first."""
        return self.timeout_ms + self.sweep_ms


@dataclass
class Buffer:
    """State of one open episode, shared by the batch fold and the streaming operator."""

    rules: EpisodeRules
    opened: int | None = None
    kinds: set = field(default_factory=set)

    def expired(self, now: int) -> bool:
        return self.opened is not None and now >= self.rules.expiry(self.opened)

    def add(self, now: int, kind: str | None) -> str | None:
        """Take one message in; says how the episode closed, None while it stays open."""
        if self.opened is None:
            self.opened = now
        self.kinds.add(kind)
        if len(self.kinds) >= self.rules.expected:
            return "complete"
        if now >= self.opened + self.rules.timeout_ms:
            return "partial"
        return None

    def reset(self) -> None:
        self.opened = None
        self.kinds = set()


_LABELS = [("opened_ms", pa.int64()), ("opened_seq", pa.int64()), ("closes", pa.string())]


def _fold_sorted(rules: EpisodeRules, key: str, ts: str, seq: str, kind: str):
    """Label rows that come sorted by key and arrival; state crosses batch borders."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, current, opened_seq = Buffer(rules), None, None
        for batch in batches:
            opened, seqs, closes = [], [], []
            columns = [batch.column(c).to_pylist() for c in (key, ts, seq, kind)]
            for task, now, number, name in zip(*columns):
                if task != current or buffer.expired(now):
                    buffer.reset()
                    current = task
                if buffer.opened is None:
                    opened_seq = number
                outcome = buffer.add(now, name)
                opened.append(buffer.opened)
                seqs.append(opened_seq)
                closes.append(outcome)
                if outcome:
                    buffer.reset()
            labels = [pa.array(v, t) for v, (_, t) in zip((opened, seqs, closes), _LABELS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *labels], names=[*batch.schema.names, *[n for n, _ in _LABELS]]
            )

    return fold


_LABEL_FIELDS = [
    T.StructField("opened_ms", T.LongType()),
    T.StructField("opened_seq", T.LongType()),
    T.StructField("closes", T.StringType()),
]


def _dealt(*keys: str) -> Column:
    """What rows are dealt to tasks by where Python relies on it.

    Dealt by the keys themselves behind a join on these, they would not be dealt again, and a
    join that turns out small may then read its input in other parts.
    """
    return F.xxhash64(*keys)


def _label_plain(results: DataFrame, rules: EpisodeRules, key: str, ts: str, seq: str, kind: str) -> DataFrame:
    schema = T.StructType([*results.schema.fields, *_LABEL_FIELDS])
    ordered = results.repartition(_dealt(key)).sortWithinPartitions(key, ts, seq, kind)
    return ordered.mapInArrow(_fold_sorted(rules, key, ts, seq, kind), schema)


def _starts(
    times: np.ndarray, kinds: np.ndarray, begins: np.ndarray, rules: EpisodeRules
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For an episode starting at each row: where the next one starts, its last row, whether it is complete, and the end of its group.

    Groups of rows lie one behind the other and begin at `begins`; the end of the group as
    the next start means it lies beyond the rows given.
    """
    n = len(times)
    sizes = np.diff(begins, append=n)
    stop = np.repeat(begins + sizes, sizes)
    # Groups are set apart by more than any of them spans, so one search serves all.
    since = times - np.repeat(times[begins], sizes)
    apart = since + np.repeat(np.arange(len(begins)), sizes) * (since.max(initial=0) + rules.timeout_ms + 1)
    after = np.searchsorted(apart, apart + rules.timeout_ms, side="left")
    filled = [n] * n
    names = kinds.tolist()
    for begin, limit in zip(begins.tolist(), (begins + sizes).tolist()):
        counts: dict = {}
        end = begin
        for start in range(begin, limit):  # window of the fewest rows from `start` with enough kinds
            while end < limit and len(counts) < rules.expected:
                counts[names[end]] = counts.get(names[end], 0) + 1
                end += 1
            if len(counts) < rules.expected:
                break  # nor is it filled from any later row
            filled[start] = end - 1
            counts[names[start]] -= 1
            if counts[names[start]] == 0:
                del counts[names[start]]
    filled = np.array(filled, np.int64)
    following = np.where(after < stop, np.append(times, 0)[after], np.iinfo(np.int64).max)
    late = following < rules.expiry(times)
    follow = np.where(filled < after, filled + 1, np.where(late, after + 1, after))
    last = np.where(filled < after, filled, np.where(late, after, after - 1))
    last = np.minimum(last, stop - 1)
    return np.minimum(follow, stop), last, filled <= last, stop


def next_starts(times: np.ndarray, kinds: np.ndarray, rules: EpisodeRules) -> tuple[np.ndarray, np.ndarray]:
    """For an episode starting at each row: where the next one starts, and the last own row.

    `len(times)` as the next start means it lies beyond the rows given.
    """
    return _starts(times, kinds, np.zeros(min(len(times), 1), np.int64), rules)[:2]


def _blocks(rows: DataFrame, width: int, reach: int) -> DataFrame:
    """Give each row its block of time, and a copy to the block before when near its start."""
    block = F.floor(F.col("ts_ms") / width).cast("long")
    near = F.pmod(F.col("ts_ms"), F.lit(width)) < reach
    targets = F.when(near, F.array(block, block - 1)).otherwise(F.array(block))
    return rows.withColumn("own_block", block).withColumn("block", F.explode(targets))


_BLOCK = ["task", "block"]
_NO_SEQ = np.iinfo(np.int64).max


def _by_block(rows: DataFrame) -> DataFrame:
    """Rows of a block of a task side by side in the order of arrival; missing values come last."""
    order = [F.col("ts_ms"), F.asc_nulls_last("seq"), F.asc_nulls_last("kind"), F.col("row")]
    return rows.repartition(_dealt(*_BLOCK)).sortWithinPartitions(*_BLOCK, *order)


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """Where the blocks begin."""
    new = np.ones(rows.num_rows, bool)
    new[1:] = False
    for name in _BLOCK:
        column = rows.column(name)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of whole blocks; held is the one block whose end has not come."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        begins = _begins(batch)
        if held and all(held[-1].column(c)[-1] == batch.column(c)[0] for c in _BLOCK):
            begins = begins[1:]
        if len(begins) and (held or begins[-1]):
            cut = int(begins[-1])
            if cut:
                held.append(batch.slice(0, cut))
            yield joined()
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield joined()


def _arrivals(rows: pa.RecordBatch, rules: EpisodeRules):
    """Times, sequence numbers, which rows are the block's own, where blocks begin, and `_starts`."""
    begins = _begins(rows)
    times = rows.column("ts_ms").to_numpy()
    seqs = pc.fill_null(rows.column("seq"), _NO_SEQ).to_numpy(zero_copy_only=False)
    own = rows.column("own_block").to_numpy() == rows.column("block").to_numpy()
    kinds = rows.column("kind").dictionary_encode("encode").indices.to_numpy()
    return times, seqs, own, begins, _starts(times, kinds, begins, rules)


def _exits(rules: EpisodeRules, width: int):
    """Where episodes entering a block leave it, for every row they could enter at."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            times, seqs, own, begins, (follow, _, _, stop) = _arrivals(rows, rules)
            inside = np.append(own, False)[follow] & (follow < stop)
            leave = follow.tolist()
            for i in np.flatnonzero(own & inside)[::-1].tolist():
                leave[i] = leave[leave[i]]
            # Episodes can enter at a row within reach of the block's start, or at the next one.
            block = rows.column("block").to_numpy()
            entry = np.append(False, times[:-1] < block[:-1] * width + rules.reach_ms)
            entry[begins] = True
            at = np.flatnonzero(entry & own)
            left = np.array(leave, np.int64)[at]
            found = left < stop[at]
            beyond = (block[at] + 1) * width + rules.reach_ms
            columns = [
                rows.column("task").take(pa.array(at)), pa.array(block[at]), pa.array(times[at]), pa.array(seqs[at]),
                pa.array(np.where(found, np.append(times, 0)[left], beyond)),
                pa.array(np.where(found, np.append(seqs, 0)[left], np.iinfo(np.int64).min)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["task", "block", "entry_ms", "entry_seq", "exit_ms", "exit_seq"])

    return exits


def _walk_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the exits from block to block; keeps the one row per block really entered."""
    task = block = None
    wanted = (-(2**63), -(2**63))
    for batch in batches:
        keep = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for name, number, entry_ms, entry_seq, exit_ms, exit_seq in zip(*columns):
            if name != task:
                task, block, wanted = name, None, (-(2**63), -(2**63))
            entered = number != block and (entry_ms, entry_seq) >= wanted
            if entered:
                block, wanted = number, (exit_ms, exit_seq)
            keep.append(entered)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _label_blocks(rules: EpisodeRules):
    """Label the rows of blocks from their entries on, and the copies their last episodes reach."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            times, seqs, own, begins, (follow, last, full, stop) = _arrivals(rows, rules)
            entry_ms, entry_seq = rows.column("entry_ms").to_numpy(), rows.column("entry_seq").to_numpy()
            entered = (times > entry_ms) | ((times == entry_ms) & (seqs >= entry_seq))
            early = np.add.reduceat((~entered).astype(np.int64), begins)
            goes_on = (np.append(own, False)[follow] & (follow < stop)).tolist()
            following, first = follow.tolist(), []
            for at in (begins + early).tolist():
                first.append(at)
                while goes_on[at]:
                    at = following[at]
                    first.append(at)
            first = np.array(first, np.int64)
            end = last[first]
            sizes = end - first + 1
            opened = np.repeat(first, sizes)
            mine = opened + np.arange(len(opened)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            closes = np.full(len(times), None, dtype=object)
            closes[end[times[end] >= times[first] + rules.timeout_ms]] = "partial"
            closes[end[full[first]]] = "complete"
            columns = [
                rows.column("row").take(pa.array(mine)), pa.array(times[opened]), rows.column("seq").take(pa.array(opened)),
                pa.array(closes[mine], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "opened_ms", "opened_seq", "closes"])

    return label


def _label_hot(
    results: DataFrame, rules: EpisodeRules, key: str, ts: str, seq: str, kind: str, reaches_per_block: int
) -> DataFrame:
    width = rules.reach_ms * reaches_per_block
    # Rows get numbers that stay: labels find their rows by these, whatever `seq` repeats.
    results = cut_lineage(results.withColumn("_row", F.monotonically_increasing_id()))
    narrow = results.select(
        F.col(key).alias("task"), F.col(ts).cast("long").alias("ts_ms"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"),
        F.col("_row").alias("row"),
    )
    blocks = _blocks(narrow, width, rules.reach_ms)
    task_type = narrow.schema["task"].dataType.simpleString()
    exits = _by_block(blocks).mapInArrow(
        _exits(rules, width),
        f"task {task_type}, block long, entry_ms long, entry_seq long, exit_ms long, exit_seq long",
    )
    entered = (
        exits.repartition("task").sortWithinPartitions("task", "block", "entry_ms", "entry_seq")
        .mapInArrow(_walk_blocks, exits.schema)
        .select("task", "block", "entry_ms", "entry_seq")
    )
    labels = _by_block(blocks.join(entered, _BLOCK)).mapInArrow(
        _label_blocks(rules), "row long, opened_ms long, opened_seq long, closes string"
    )
    labelled = results.join(labels.withColumnRenamed("row", "_row"), "_row")
    return labelled.select(*(c for c in results.columns if c != "_row"), "opened_ms", "opened_seq", "closes")


def assign_episodes(
    results: DataFrame,
    rules: EpisodeRules = EpisodeRules(),
    key: str = "task_id",
    ts: str = "ts_ms",
    seq: str = "seq",
    kind: str = "analyzer_type",
    split_rows: int = 2_000_000,
    reaches_per_block: int = 64,
) -> DataFrame:
    """Add `opened_ms`, `opened_seq` (the episode of a row) and `closes` (how it ended).

    `ts` is the arrival in milliseconds, `seq` breaks ties, and of equal ones the kind does.
    A count per task, read from the key column alone, decides which tasks are split; the
    labels are the same either way.
    """
    sizes = results.groupBy(key).count().filter(F.col("count") > split_rows).select(key)
    hot = sizes.limit(_BROADCAST_TASKS + 1).collect()
    if not hot:
        return _label_plain(results, rules, key, ts, seq, kind)
    if len(hot) <= _BROADCAST_TASKS:
        # At most _BROADCAST_TASKS ids, counted above.
        sizes = F.broadcast(results.sparkSession.createDataFrame(hot, sizes.schema))
    plain = results.join(sizes, key, "left_anti")
    heavy = results.join(sizes, key, "left_semi")
    return _label_plain(plain, rules, key, ts, seq, kind).unionByName(
        _label_hot(heavy, rules, key, ts, seq, kind, reaches_per_block)
    )


def replay_aggregation(
    results: DataFrame,
    rules: EpisodeRules = EpisodeRules(),
    split_rows: int = 2_000_000,
    reaches_per_block: int = 64,
) -> DataFrame:
    """One row per episode: when it opened and closed, its status and its results.

    Expects `task_id, analyzer_type, score, features, reason, analyzed_at, ts_ms, seq`.
    Status is `complete`, `partial` or `timeout`; a timed-out episode has no results, they
    are discarded and never gathered. Identical messages of an episode count once.
    """
    labelled = assign_episodes(results, rules, split_rows=split_rows, reaches_per_block=reaches_per_block)
    episode = ["task_id", "opened_ms", "opened_seq"]
    fields = ["analyzer_type", "score", "features", "reason", "analyzed_at"]
    # Combined before the shuffle, so copies vanish there; written, for it is read twice.
    once = cut_lineage(
        labelled.groupBy(*episode, *fields).agg(
            F.min(F.struct("ts_ms", "seq")).alias("arrival"),
            F.max("ts_ms").alias("last_ms"),
            F.max("closes").alias("closes"),
        )
    )
    # Figures of all episodes are sums; results are gathered for those that closed only.
    figures = once.groupBy(*episode).agg(
        F.max("last_ms").alias("last_ms"),
        F.coalesce(F.max("closes"), F.lit("timeout")).alias("status"),
        F.count("*").cast("int").alias("n_results"),
    )
    closed = once.filter(F.col("closes").isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in episode)).distinct()
    same = [once[c].eqNullSafe(closed[f"_{c}"]) for c in episode]
    items = once.join(closed, same, "left_semi").groupBy(*episode).agg(
        F.sort_array(F.collect_list(F.struct("arrival", *fields))).alias("items")
    )
    items = items.select(
        *(F.col(c).alias(f"_{c}") for c in episode),
        F.transform("items", lambda i: F.struct(*[i[f].alias(f) for f in fields])).alias("results"),
    )
    return figures.join(items, [figures[c].eqNullSafe(items[f"_{c}"]) for c in episode], "left").select(
        *episode, "last_ms", "status", "n_results", "results"
    )
