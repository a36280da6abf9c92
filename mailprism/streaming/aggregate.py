"""Keyed aggregation of result streams with a deadline.

The tasks are dealt to shards by a hash, and a shard is the key of the state: every call to the
state is a round trip between Python and the JVM, so one call carries the buffers, or the rows,
of many tasks. A shard's state is kept in parts of bounded size: chunks with the buffers of some
tasks each, maps of the results of tasks that hold many, and a map of runs of rows that wait for
their turn. No part grows with a task or with their number. With event time as the clock, rows
wait in the order of their arrival stamps until the watermark has passed them, so the order of
batches does not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mailprism import schemas
from mailprism.operators.episodes import Buffer, EpisodeRules

_ITEM = [f.name for f in schemas.RESULT_ITEM.fields]
_OUTPUT = "task_id string, status string, opened_ms long, last_ms long, n_results int, items array<string>"
_CLOCK = "runs long, chunks long, timer_ms long"
_CHUNK = (
    "tasks array<string>, opened_ms array<long>, last_ms array<long>, kinds array<array<string>>, n_stored array<long>, "
    "item_runs array<long>, until_ms array<long>, newest array<array<string>>"
)
_ROW = ["ts_ms", "seq", "analyzer_type", "item", "task_id"]
_RUN = "ts_ms array<long>, seq array<long>, kinds array<string>, items array<string>, tasks array<string>"
# Shards of the tasks: so many that each has few open ones. A checkpoint keeps to its number.
SHARDS = 1024
# Rows in a run that waits, results in a stored run, and results held in memory before they go to the state.
RUN_ROWS = 256
HELD_ITEMS = 4096
# Newest results that stay beside a task's figures, tasks in a chunk, and closed buffers returned at a time.
INLINE_ITEMS, CHUNK_TASKS, OUT_ROWS = 32, 64, 1024
_NEVER = (1 << 62) - 1
_NO_SEQ = -(1 << 63)


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Closed buffers as frames of bounded size."""
    while part := list(islice(rows, OUT_ROWS)):
        yield pd.DataFrame(part)


def _digest(item: str) -> str:
    return hashlib.md5(item.encode("utf-8", "surrogatepass")).hexdigest()


class TaskBuffers(StatefulProcessor):
    """The buffers of all tasks: fills, deadlines, copies within a buffer, and tombstones."""

    def __init__(self, rules: EpisodeRules, event_time: bool, tombstone_ms: int = 0) -> None:
        self.rules, self.event_time, self.tombstone_ms = rules, event_time, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", _CLOCK)
        self.chunks = handle.getMapState("chunks", "number long", _CHUNK)
        self.items = handle.getMapState("items", "task string, number long", "items array<string>")
        self.seen = handle.getMapState("seen", "task string, digest string", "number long")
        self.waiting = handle.getMapState("waiting", "first_ms long, number long", _RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard = _Shard(self)
        frames = (sorted(zip(*(f[c].tolist() for c in _ROW)), key=lambda r: r[:2]) for f in rows)
        if self.event_time:
            for arrived in frames:
                shard.wait(arrived)
            yield from _frames(shard.advance(timerValues.getCurrentWatermarkInMs()))
        else:
            yield from _frames(shard.now(timerValues.getCurrentProcessingTimeInMs(), frames))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shard = _Shard(self)
        shard.timer = None  # the expired one is gone
        if self.event_time:
            yield from _frames(shard.advance(timerValues.getCurrentWatermarkInMs()))
        else:
            yield from _frames(shard.now(timerValues.getCurrentProcessingTimeInMs(), ()))

    def close(self) -> None:
        pass


class _Task:
    """One task during a call: its figures, and in `fresh` the newest results, those not stored in runs."""

    __slots__ = ("name", "chunk", "buffer", "last", "n_stored", "item_runs", "until", "fresh")

    def __init__(self, rules: EpisodeRules, name: str | None) -> None:
        self.name, self.chunk, self.buffer, self.last = name, None, Buffer(rules), 0
        self.n_stored, self.item_runs, self.until = 0, 0, None
        self.fresh: dict[str, None] = {}

    @property
    def lives(self) -> bool:
        return self.buffer.opened is not None or self.until is not None


class _Shard:
    """One shard during a call: its tasks that have a buffer or a tombstone, and the rows that wait."""

    def __init__(self, state: TaskBuffers) -> None:
        self.state, self.rules = state, state.rules
        self.tasks: dict[str | None, _Task] = {}
        # Chunks to be written anew, and results in memory.
        self.changed: set[int] = set()
        self.held = 0
        self.next_wait = _NEVER
        known = state.clock.get()
        self.known = known is not None
        self.runs, self.n_chunks, self.timer = known if self.known else (0, 0, None)
        for (number,), chunk in state.chunks.iterator() if self.known else ():
            for name, opened, last, kinds, n_stored, item_runs, until, newest in zip(*chunk):
                task = self.tasks[name] = _Task(self.rules, name)
                task.chunk, task.last, task.n_stored, task.item_runs, task.until = number, last, n_stored, item_runs, until
                task.buffer.opened, task.buffer.kinds = opened, set(kinds)
                task.fresh = dict.fromkeys(newest)
                self.held += len(newest)

    def wait(self, rows: list[tuple]) -> None:
        """Put rows, given in the order of arrival, into the state in runs."""
        for at in range(0, len(rows), RUN_ROWS):
            self._put([list(column) for column in zip(*rows[at : at + RUN_ROWS])])

    def now(self, now: int, frames: Iterable[list[tuple]]) -> Iterator[dict]:
        """Rows that arrive now; the deadlines come after them, as a sweep does."""
        for arrived in frames:
            for _, _, kind, item, name in arrived:
                yield from self.take(name, now, kind, item)
        yield from self.sweep(now)
        self.leave()

    def _put(self, run: list[list]) -> None:
        first = int(run[0][0])
        self.state.waiting.updateValue((first, self.runs), tuple(run))
        self.runs += 1
        self.next_wait = min(self.next_wait, first)

    def _run(self, key: tuple, watermark: int) -> Iterator[tuple]:
        """The rows of a run before the watermark; the others wait on in a run of their own."""
        columns = self.state.waiting.getValue(key)
        self.state.waiting.removeKey(key)
        n = sum(ts < watermark for ts in columns[0])
        if n < len(columns[0]):
            self._put([list(c[n:]) for c in columns])
        yield from zip(*(c[:n] for c in columns))

    def _ordered(self, watermark: int) -> Iterator[tuple]:
        """Rows before the watermark in the order of arrival; a run is read when its first row is due."""
        keys = sorted(tuple(k) for k in self.state.waiting.keys())
        self.next_wait = next((first for first, _ in keys if first >= watermark), _NEVER)
        open_: list = []
        for first, number in [*((f, n) for f, n in keys if f < watermark), (watermark, -1)]:
            while open_ and open_[0][0][0] < first:
                _, tie, row, run = open_[0]
                yield row
                following = next(run, None)
                heapq.heapreplace(open_, (following[:4], tie, following, run)) if following else heapq.heappop(open_)
            if number >= 0:
                run = self._run((first, number), watermark)
                row = next(run)
                heapq.heappush(open_, (row[:4], number, row, run))

    def advance(self, watermark: int) -> Iterator[dict]:
        """Everything that is certain once no row before the watermark can come any more."""
        if self.known or self.runs:
            for ts, _, kind, item, name in self._ordered(watermark):
                yield from self.take(name, int(ts), kind, item)
        yield from self.sweep(watermark)
        self.leave()

    def sweep(self, now: int) -> Iterator[dict]:
        """Buffers and tombstones whose time is over."""
        for task in self.tasks.values():
            if task.buffer.opened is not None and self._deadline(task) <= now:
                yield self.closed(task, "timeout")
            if task.until is not None and task.until <= now:
                self._touch(task)
                task.until = None

    def _deadline(self, task: _Task) -> int:
        opened = task.buffer.opened
        return self.rules.expiry(opened) if self.state.event_time else opened + self.rules.timeout_ms

    def _touch(self, task: _Task) -> None:
        if task.chunk is not None:
            self.changed.add(task.chunk)

    def take(self, name: str | None, now: int, kind: str, item: str) -> Iterator[dict]:
        """One result that arrives now."""
        task = self.tasks.get(name)
        if task is None:
            task = self.tasks[name] = _Task(self.rules, name)
        if self.state.event_time and task.buffer.expired(now):
            yield self.closed(task, "timeout")
        if task.until is not None:
            if now < task.until:
                return
            task.until = None
        self._touch(task)
        if item not in task.fresh and not (task.n_stored and self.state.seen.containsKey((name, _digest(item)))):
            task.fresh[item] = None
            self.held += 1
            if self.held >= HELD_ITEMS and len(task.fresh) > INLINE_ITEMS:
                self._store(task)
        outcome, task.last = task.buffer.add(now, kind), now
        if outcome:
            yield self.closed(task, outcome)
            if self.state.tombstone_ms:
                task.until = now + self.state.tombstone_ms

    def _store(self, task: _Task) -> None:
        items = list(task.fresh)
        for at in range(0, len(items), RUN_ROWS):
            self.state.items.updateValue((task.name, task.item_runs), (items[at : at + RUN_ROWS],))
            task.item_runs += 1
        for item in items:
            self.state.seen.updateValue((task.name, _digest(item)), (task.item_runs,))
        task.n_stored += len(items)
        self._forget(task)

    def _forget(self, task: _Task) -> None:
        self.held -= len(task.fresh)
        task.fresh = {}

    def _stored(self, task: _Task) -> Iterator[str]:
        """The results of a task that lie in the state, in their order; they are removed."""
        for number in range(task.item_runs):
            (items,) = self.state.items.getValue((task.name, number))
            self.state.items.removeKey((task.name, number))
            for item in items:
                self.state.seen.removeKey((task.name, _digest(item)))
                yield item

    def closed(self, task: _Task, status: str) -> dict:
        """The row of a buffer that ends; the results of one that timed out are thrown away."""
        self._touch(task)
        items = None
        if status != "timeout":
            items = [*self._stored(task), *task.fresh]
        else:
            for _ in self._stored(task):
                pass
        row = {
            "task_id": task.name, "status": status, "opened_ms": task.buffer.opened, "last_ms": task.last,
            "n_results": task.n_stored + len(task.fresh), "items": items,
        }
        task.buffer.reset()
        task.n_stored = task.item_runs = 0
        self._forget(task)
        return row

    def leave(self) -> None:
        """Put what stays into the state, with one timer for whatever is due first."""
        moved = [t for t in self.tasks.values() if t.lives and (t.chunk is None or t.chunk in self.changed)]
        for task in moved:
            if len(task.fresh) > INLINE_ITEMS:
                self._store(task)
        # Tasks of changed chunks are packed anew with the new ones, so no chunk stays nearly empty.
        free = sorted(self.changed, reverse=True)
        for part in _packed(moved):
            number = free.pop() if free else self.n_chunks
            self.n_chunks = max(self.n_chunks, number + 1)
            rows = [
                (t.name, t.buffer.opened, t.last, sorted(t.buffer.kinds), t.n_stored, t.item_runs, t.until, list(t.fresh)) for t in part
            ]
            self.state.chunks.updateValue((number,), tuple(list(column) for column in zip(*rows)))
        for number in free:
            self.state.chunks.removeKey((number,))
        due = [t.until for t in self.tasks.values() if t.until is not None]
        due += [self._deadline(t) for t in self.tasks.values() if t.buffer.opened is not None]
        if self.next_wait < _NEVER:
            due.append(self.next_wait + 1)
        timer = min(due, default=None)
        if timer != self.timer:
            if self.timer is not None:
                self.state.handle.deleteTimer(self.timer)
            if timer is not None:
                self.state.handle.registerTimer(timer)
        if timer is not None:
            self.state.clock.update((self.runs, self.n_chunks, timer))
        elif self.known:
            self.state.clock.clear()


def _packed(tasks: list[_Task]) -> Iterator[list[_Task]]:
    """Tasks in parts that hold few tasks and few results."""
    part, n = [], 0
    for task in tasks:
        if part and (len(part) == CHUNK_TASKS or n + len(task.fresh) > RUN_ROWS):
            yield part
            part, n = [], 0
        part.append(task)
        n += len(task.fresh)
    if part:
        yield part


def aggregate_stream(
    results: DataFrame, rules: EpisodeRules = EpisodeRules(), event_time: str | None = None, tombstone_ms: int = 0, shards: int = SHARDS
) -> DataFrame:
    """Aggregates and timeouts of a stream of results.

    Expects `task_id, analyzer_type, score, features, reason, analyzed_at, ts_ms, seq`.
    By default the clock is processing time: the deadline runs from the first result, and
    the trigger interval is the sweep, so run the query with a trigger of
    `rules.sweep_ms`. With `event_time`, a watermarked timestamp column, the arrival stamp
    `ts_ms` (the same moment in milliseconds) is the clock. A row then waits until the
    watermark has passed it, and the outcome equals the batch replay of the same rows in
    whatever order they come, as long as none is later than the watermark allows.

    For `tombstone_ms` after a complete or partial aggregate the results of its task are
    swallowed; by default the task is forgotten at once and a further result opens a buffer.
    The state needs the RocksDB provider. Its key is one of `shards` shards of the tasks; a
    call reads the figures of all open tasks of a shard, and a checkpoint keeps to its number.
    """
    item = F.to_json(F.struct(*_ITEM), {"ignoreNullFields": "false"})
    kind = F.coalesce("analyzer_type", F.lit("")).alias("analyzer_type")
    shard = F.pmod(F.xxhash64("task_id"), F.lit(shards)).alias("shard")
    # Without NULLs, of which pandas would make floating-point numbers.
    seq = F.coalesce("seq", F.lit(_NO_SEQ)).alias("seq")
    narrow = results.select(shard, "task_id", kind, item.alias("item"), "ts_ms", seq, *([event_time] if event_time else []))
    folded = narrow.groupBy("shard").transformWithStateInPandas(
        TaskBuffers(rules, event_time is not None, tombstone_ms), _OUTPUT, "append", "EventTime" if event_time else "ProcessingTime"
    )
    items = F.transform("items", lambda text: F.from_json(text, schemas.RESULT_ITEM))
    return folded.select("task_id", "status", "opened_ms", "last_ms", "n_results", items.alias("results"))


def aggregates_of(closed: DataFrame) -> DataFrame:
    """The closed buffers that go on to the verdict."""
    return closed.filter(F.col("status") != "timeout").select(
        "task_id", "results", F.timestamp_millis("last_ms").alias("aggregated_at")
    )
