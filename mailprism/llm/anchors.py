"""Anchors: positions chosen by content, one at least in every string of the match length.

Every string of `match` bytes has the `match - gram + 1` grams of `gram` bytes that lie in
it; its anchor is the one with the smallest hash, the leftmost of equals. Equal strings
have their anchors at equal places, wherever they occur, so suffixes that start at anchors
are enough to find every repeated string. The strings of one anchor start next to each
other, so an anchor stands for a range of starts.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_bytes(match: int) -> int:
    """8, 16, 32, ... bytes: the most that is at most a quarter of the match, 8 at least."""
    size = 8
    while 8 * size <= match:
        size *= 2
    return size


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes at each position; positions near the end see zeros."""
    n = len(data)
    padded = data + bytes(gram + 16)
    hashes = np.empty(n + 8 & ~7, np.uint64)
    for shift in range(8):
        hashes[shift::8] = np.frombuffer(padded, "<u8", len(hashes[shift::8]), shift)
    hashes = _mixed(hashes[:n] * _M1)
    size = 8
    while size < gram:
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - size)] = hashes[size:]
        hashes = _mixed(hashes * _M1 + ahead)
        size *= 2
    return hashes


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of `width` keys from each position on, while they last."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def find_anchors(texts: list[bytes], match: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, gram hash) of all anchors of some texts.

    Places count from the start of their text. Texts shorter than `match` have none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or sizes.max() < match:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    gram = gram_bytes(match)
    hashes = gram_hashes(b"".join(texts), gram)
    keys = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    minima = _window_minima(keys, match - gram + 1)
    counts = np.maximum(0, sizes - match + 1)
    offsets = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + inside
    place = (minima[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Anchors of different texts are different places.
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    of = text[first]
    return of, place[first] - offsets[of], inside[first], inside[last], hashes[place[first]]
