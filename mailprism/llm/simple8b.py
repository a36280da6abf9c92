"""Simple-8b: unsigned integers in 64-bit words, four bits of selector, sixty of payload.

Selector 1 to 14 packs so many values of one width; 15 is the escape: its payload is the
number of full 64-bit values in the words behind it. Values are coded in blocks of a fixed
number, each with the offset of its first word, so blocks can be coded and decoded side by
side: the coder takes one step in all blocks at a time, the decoder works per selector on
all words at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PAYLOAD = 60
ESCAPE = 15
# Fixed values: (count, width) of selectors 1 to 14, most values first.
PACKINGS = (
    (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)


# Bits of each 16-bit number.
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; above 2**53 rounding may give one more, never one less."""
    if values.max() < len(_BITS):
        return _BITS.take(values.astype(np.int64))
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for each block of `BLOCK` values the offset of its first word."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = values
    widths = np.zeros((blocks, BLOCK + PAYLOAD), np.uint8)
    widths[:, :BLOCK] = _widths(padded).reshape(blocks, BLOCK)
    # selector[b, i]: the one that packs most of the values from i on in block b.
    selector = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest, reach = widths, 1
    for choice in range(len(PACKINGS), 0, -1):
        count, width = PACKINGS[choice - 1]
        while reach < count:
            step = min(reach, count - reach)
            shifted = np.zeros_like(widest)
            shifted[:, :-step] = widest[:, step:]
            widest, reach = np.maximum(widest, shifted), reach + step
        np.copyto(selector, np.uint8(choice), where=widest[:, :BLOCK] <= width)
    counts = np.array([0, *(count for count, _ in PACKINGS), 1])
    length = np.full(blocks, BLOCK)
    length[-1] = n - (blocks - 1) * BLOCK
    # Places of the words among all values, one step of all blocks at a time.
    reach, flat = counts.take(selector), selector.reshape(-1)
    start = np.arange(blocks) * BLOCK
    end, at, steps = start + length, start, []
    while len(at):
        steps.append(at)
        at = at + reach.reshape(-1).take(at)
        inside = at < end
        at, end = at[inside], end[inside]
    place = np.sort(np.concatenate(steps))
    chosen = flat.take(place)
    sizes = np.where(chosen == ESCAPE, 2, 1)
    ends = np.cumsum(sizes)
    words = np.zeros(ends[-1], np.uint64)
    first = ends - sizes
    wide = np.zeros((blocks, BLOCK + PAYLOAD), np.uint64)
    wide[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    wide, block = wide.reshape(-1), place // BLOCK
    source = place + block * PAYLOAD
    for choice, (count, width) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(chosen == choice)
        if len(mine):
            word, here = np.full(len(mine), choice << PAYLOAD, np.uint64), source.take(mine)
            for j in range(count):
                word |= wide.take(here + j) << np.uint64(j * width)
            words[first.take(mine)] = word
    mine = np.flatnonzero(chosen == ESCAPE)
    words[first[mine]] = np.uint64(ESCAPE << PAYLOAD | 1)
    words[first[mine] + 1] = wide[source[mine]]
    offsets = first[np.searchsorted(block, np.arange(blocks))]
    return words.astype("<u8"), offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The `n` values of all blocks; `offsets` may be a slice, `n` its number of values."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(offsets)
    selector = (words >> np.uint64(PAYLOAD)).astype(np.int64)
    # Words behind an escape are data whatever their top bits are; few, so found one by one.
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE):
        if not raw[at]:
            raw[at + 1 : at + 1 + int(words[at] & np.uint64((1 << PAYLOAD) - 1))] = True
    counts = np.array([0, *(count for count, _ in PACKINGS), 0])[selector]
    counts[raw] = 1
    offsets = np.asarray(offsets)
    before = np.cumsum(counts) - counts
    # Where a word's values go: a block has room for what its last word holds beyond it.
    room = BLOCK + PAYLOAD
    moved = np.arange(blocks) * room - before[offsets]
    target = before + np.repeat(moved, np.diff(np.append(offsets, len(words))))
    out = np.zeros(blocks * room, np.uint64)
    for choice, (count, width) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero((selector == choice) & ~raw)
        if len(mine):
            mask, word, here = np.uint64((1 << width) - 1), words.take(mine), target.take(mine)
            for j in range(count):
                out[here + j] = word >> np.uint64(j * width) & mask
    mine = np.flatnonzero(raw)
    out[target[mine]] = words[mine]
    out = out.reshape(blocks, room)
    return out[:, :BLOCK].reshape(-1)[:n]
