"""Secrets in texts: keyword automaton, anchored expressions near its hits, checksums.

One Aho-Corasick pass over the ASCII-lowered text finds keywords. Only at a hit an anchored
expression looks at the original text, so a text without keywords costs one linear pass.
Long hexadecimal runs have no keyword of their own; their keywords are all four-digit
hexadecimal strings, which are rare in prose and occur in every run of four digits or more.
Tokens with an embedded checksum are reported only if the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of ties: first the base, then those with a checksum.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm", "grafana")
KINDS = BASE_KINDS + CHECKED_KINDS
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
PLACEHOLDER = "<secret>"

# The keywords, and what must stand around them.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_AFTER_WORD = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[opusr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_GRAFANA = re.compile(r"(glsa_[A-Za-z0-9]{32})_([0-9a-f]{8})(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

RESULT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

_automaton = None


def base62(number: int, width: int) -> str:
    digits = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        digits = _BASE62[digit] + digits
    return digits


def _crc62(match: re.Match) -> bool:
    return base62(zlib.crc32(match[1].encode()), 6) == match[2]


def _crc_hex(match: re.Match) -> bool:
    return f"{zlib.crc32(match[1].encode()):08x}" == match[2]


CHECKED = {"github": (_GITHUB, _crc62), "npm": (_NPM, _crc62), "grafana": (_GRAFANA, _crc_hex)}


def _keywords():
    """The automaton, built once per Python worker; a value is (kind, length of the keyword)."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for digits in product("0123456789abcdef", repeat=4):
            machine.add_word("".join(digits), ("hex", 4))
        for word in ASSIGN_WORDS:
            machine.add_word(word, ("assign", len(word)))
        for word, kind in (("akia", "access"), ("npm_", "npm"), ("glsa_", "grafana")):
            machine.add_word(word, (kind, len(word)))
        for letter in "opusr":
            machine.add_word(f"gh{letter}_", ("github", 4))
        machine.make_automaton()
        _automaton = machine
    return _automaton


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed; code points."""
    # bytes.lower() changes A-Z only, so positions stay.
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found = []
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, kept or not
    for last, (kind, length) in _keywords().iter(lowered):
        start = last + 1 - length
        if start < done[kind]:
            continue
        if kind == "hex":
            # A run is seen first at its first four digits, or at capitals, which do not count.
            match = _HEX.match(text, start)
            if match is None:
                continue
            kept = match.end() - start >= MIN_HEX
        elif kind == "assign":
            match = _AFTER_WORD.match(text, last + 1)
            if match is None:
                continue
            kept = match.end() - match.start(1) >= MIN_ASSIGN
        elif kind == "access":
            match = _ACCESS.match(text, start)
            if match is None:
                continue
            kept = match.end() - start >= MIN_ACCESS
        else:
            pattern, holds = CHECKED[kind]
            match = pattern.match(text, start)
            if match is None:
                continue
            kept = holds(match)
        done[kind] = match.end()
        if kept:
            found.append((start, match.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _redacted(text: str) -> str:
    """The text with every maximal run of secret characters replaced by a placeholder."""
    spans = find_secrets(text)
    if not spans:
        return text
    parts, at = [], 0
    start, end = spans[0][:2]
    for left, right, _ in [*spans[1:], (len(text) + 1, len(text) + 1, "")]:
        if left < end:
            end = max(end, right)
            continue
        parts += [text[at:start], PLACEHOLDER]
        at, start, end = end, left, right
    return "".join([*parts, text[at:]])


def _scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            spans = find_secrets(text or "")
            base = [s for s in spans if s[2] in BASE_KINDS]
            counts = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
            rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda text: None if text is None else _redacted(text))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, counts per base kind, the digest and all spans.

    NULL and empty texts have no spans; repeated rows give repeated results; other columns
    are not read.
    """
    scan = F.pandas_udf(_scan, RESULT)
    found = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.*")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with each secret of the text replaced; NULL stays NULL, all rows and columns stay.

    `length_col`, if the table has it, becomes the new number of code points.
    """
    clean = F.pandas_udf(_clean, "string")
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col is not None and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out
