"""Texts as numbers of a subword vocabulary, the input of a text model.

A vocabulary file has one piece per line; a piece that continues a word begins with `##`. A
word is cut from its start into the longest pieces there are. The pieces are the keys of one
dictionary, which holds a large vocabulary in a fraction of the memory of a trie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailprism.functions.common import as_column

# Special pieces, the mark of a continuation, the longest word, the model's window.
PAD, UNKNOWN, FIRST, LAST = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
INSIDE = "##"
WORD_LETTERS = 100
MAX_TOKENS = 256

# Pieces that may go to every worker, and words whose pieces a worker remembers.
MAX_PIECES = 1_000_000
REMEMBERED = 200_000
_PARTS = re.compile(r"\w+|[^\w\s]")

# One encoder per worker: building the dictionary takes longer than a batch.
_encoders: dict[tuple, SubwordEncoder] = {}


class SubwordEncoder:
    """Longest match first over a vocabulary; its order gives the numbers."""

    def __init__(self, pieces: Sequence[str], max_tokens: int = MAX_TOKENS) -> None:
        if max_tokens < 2:
            raise ValueError("the window has no room for its first and last piece")
        numbers: dict[str, int] = {}
        for number, piece in enumerate(pieces):
            numbers.setdefault(piece, number)
        missing = [p for p in (PAD, UNKNOWN, FIRST, LAST) if p not in numbers]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.max_tokens = max_tokens
        self.pad, self.unknown, self.first, self.last = (numbers[p] for p in (PAD, UNKNOWN, FIRST, LAST))
        self._numbers = numbers
        inside = [p for p in numbers if p.startswith(INSIDE) and len(p) > len(INSIDE)]
        self._most_inside = max((len(p) - len(INSIDE) for p in inside), default=0)
        self._most = max(map(len, numbers))
        self._known: dict[str, tuple[int, ...]] = {}

    def _longest(self, word: str, at: int) -> tuple[int, int] | None:
        """(number, end) of the longest piece at a place of the word."""
        most, mark = (self._most_inside, INSIDE) if at else (self._most, "")
        for end in range(min(len(word), at + most), at, -1):
            piece = mark + word[at:end]
            # At the start of a word, a piece that continues one is no match.
            if piece in self._numbers and (at or len(piece) <= len(INSIDE) or not piece.startswith(INSIDE)):
                return self._numbers[piece], end
        return None

    def pieces_of(self, word: str) -> tuple[int, ...]:
        """Numbers of a word's pieces; of one that cannot be cut up, or is too long, the unknown piece."""
        if word not in self._known:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            out, at = [], 0
            while at < len(word) <= WORD_LETTERS:
                found = self._longest(word, at)
                if found is None:
                    break
                out.append(found[0])
                at = found[1]
            self._known[word] = tuple(out) if out and at == len(word) else (self.unknown,)
        return self._known[word]

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """(ids, mask), both `max_tokens` long: the first piece, the text's up to the window, the last, padding."""
        ids = [self.first]
        for part in _PARTS.finditer(text or ""):
            ids += self.pieces_of(part[0])
            if len(ids) >= self.max_tokens:
                break
        ids = [*ids[: self.max_tokens - 1], self.last]
        rest = self.max_tokens - len(ids)
        return ids + [self.pad] * rest, [1] * len(ids) + [0] * rest


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The pieces of a vocabulary file, by line; the file is read by Spark, so it may lie in any store."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "piece"))
    rows = lines.orderBy("n").limit(MAX_PIECES + 2).collect()
    pieces = [r.piece for r in rows]
    while pieces and not pieces[-1]:
        pieces.pop()
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return pieces


def encoded(clean: Column | str, vocabulary: Broadcast, max_tokens: int = MAX_TOKENS) -> Column:
    """Struct of `ids` and `mask` of a cleaned text, in Arrow batches; `vocabulary` is a broadcast list of pieces.

    NULL counts as an empty text: first and last piece only. Only the text of the window is cut up.
    """

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = vocabulary.value
        key = len(pieces), hash(tuple(pieces)), max_tokens
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = SubwordEncoder(pieces, max_tokens)
        for texts in batches:
            yield pd.DataFrame([_encoders[key].encode(t) for t in texts], columns=["ids", "mask"])

    return F.pandas_udf(encode, "ids array<int>, mask array<int>")(as_column(clean))
