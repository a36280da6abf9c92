"""Token ids of whole texts with a public byte-level BPE tokenizer.

The tokenizers library does the encoding. Its pre-tokenizer never joins characters across
the start of white space that follows another character, nor a letter or digit with the
comma or full stop behind it, so a text is encoded piece by piece, cut at such places, and
a worker remembers the ids of pieces it has seen. The ids are those of the whole text; a
text with white space that needs a closer look is given to the library whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
# Pieces that a worker remembers, and the longest of them; beyond that it starts anew.
MEMO_PIECES, MEMO_LENGTH = 1_200_000, 64

# Code points of white space other than space and line feed, and those some take for it.
_ODD = [0x00, 0x09, *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029,
        0x202F, *range(0x205F, 0x2065), 0x3000, 0xFEFF]
_UNUSUAL = re.compile("[" + "".join(map(chr, _ODD)) + "]")
# A space or none, and letters of the Latin blocks: one word of the pre-tokenizer.
_LATIN = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
_WORD = re.compile(f" ?[{_LATIN}]+")
# A comma or full stop that may belong to the piece before it.
_JOINED = re.compile(r"[,.](?<![^\W_][,.])")
_encoders: dict[str, Encoder] = {}


class _Places(dict):
    """Places of known pieces; -1 for any other."""

    def __missing__(self, piece: str) -> int:
        return -1


class Encoder:
    """One tokenizer with the ids of recent pieces."""

    def __init__(self, name: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        # The letter for each byte, as the pre-tokenizer itself has it.
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._letters = {b: mapped.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for b in range(128, 256):  # the second byte of a two-byte character, or its first
            char = bytes([0xC4, b]) if b < 192 else bytes([b, 0x80])
            if 0xC2 <= b < 0xE0 or b < 192:
                self._letters[b] = mapped.pre_tokenize_str(char.decode())[0][0][1 if b < 192 else 0]
        self._space = self._letters[0x20]
        self._forget()

    def _forget(self) -> None:
        self._at = _Places()
        self._starts = np.zeros(1 << 16, np.int64)
        self._counts = np.zeros(1 << 16, np.int64)
        self._ids = np.zeros(1 << 18, np.uint32)
        self._used = 0

    def _new_ids(self, pieces: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of pieces not seen before: the model's for single words, else the tokenizer's.

        All that is left for the pre-tokenizer to do to a single word is to map its bytes to
        letters, and those of ASCII letters are the letters themselves; every other piece
        takes the general way.
        """
        others, tokenize = [], self._model.tokenize
        for piece in pieces:
            if piece.isascii() and piece.removeprefix(" ").isalpha():
                yield piece, [token.id for token in tokenize(piece.replace(" ", self._space))]
            elif _WORD.fullmatch(piece):
                letters = piece.encode().decode("latin-1").translate(self._letters)
                yield piece, [token.id for token in tokenize(letters)]
            else:
                others.append(piece)
        for piece, one in zip(others, self._tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            yield piece, one.ids

    def _remember(self, pieces: list[str]) -> None:
        ids, counts, place = [], [], len(self._at)
        for piece, new in self._new_ids(pieces):
            self._at[piece] = place + len(counts)
            ids += new
            counts.append(len(new))
        counts = np.array(counts, np.int64)
        while place + len(counts) > len(self._starts):
            self._starts, self._counts = (np.concatenate([a, np.zeros_like(a)]) for a in (self._starts, self._counts))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._starts[place : place + len(counts)] = self._used + np.cumsum(counts) - counts
        self._counts[place : place + len(counts)] = counts
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of `text` as unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, np.uint32)
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if runs or _UNUSUAL.search(text):
            return self._whole(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n")
        if not _JOINED.search(text):
            cut = cut.replace(",", "\0,").replace(".", "\0.")
        pieces = cut.split("\0")
        places = self._places(pieces)
        unknown = np.flatnonzero(places < 0).tolist()
        if unknown:
            new = list(dict.fromkeys([pieces[i] for i in unknown]))
            if max(map(len, new)) > MEMO_LENGTH:
                return self._whole(text)
            if len(self._at) + len(new) > MEMO_PIECES:
                self._forget()
                new = list(dict.fromkeys(pieces))
                if len(new) > MEMO_PIECES:
                    return self._whole(text)
            self._remember(new)
            places = self._places(pieces)
        counts = self._counts.take(places)
        ends = counts.cumsum()
        index = np.repeat(self._starts.take(places) - (ends - counts), counts)
        index += np.arange(len(index))
        return self._ids.take(index)

    def _places(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self._at.__getitem__, pieces), np.int64, len(pieces))


def encoder(name: str = TOKENIZER) -> Encoder:
    """The worker's encoder of a vocabulary file; what it remembers serves later tasks too."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def document_ids(text: str | None, name: str = TOKENIZER, end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text (NULL: empty) and the end id."""
    return np.append(encoder(name).encode(text or ""), np.uint32(end_id))


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
